"""Court decisions are read by quick patterns that find what the plain ones find."""

import random

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import court as CT

BITS = ["o'", "g’", "a`", "Oʻ", "xʼ", " ", "  ", "\t", " ", "  ", "\n", "\n\n\n\n", "\r\n", " \n ", " ", "—", "Sud majlisi 2024-01-02 kuni", "yigʻilish", "12.03.2021", "Shikoyat 10 kun ichida beriladi.", "apellyatsiya", "x" * 170, "JK 12, 13 va 14-modda", "Jinoyat kodeksining 169-moddasi 2-qismi", "x" * 61 + " kodeksi 5-modda", ".", ";", "Prokuror: Rahimov C.C.", "guvoh Aliyev", "что", "Ў"]


def test_quick_patterns_equal_plain_ones(spark):
    r = random.Random(3)
    texts = ["", " ", *("".join(r.choice(BITS) + r.choice(["", " "]) for _ in range(r.choice([2, 8, 30]))) for _ in range(600))]
    c = F.col("text")
    plain_strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(F.regexp_replace(T.composed(c), r"\r\n|\r", "\n"), f"(?<=[oOgG]){T.APOSTROPHE_CLASS}", "ʻ")
    x = F.regexp_replace(F.regexp_replace(x, f"(?<![oOgG]){T.APOSTROPHE_CLASS}", "ʼ"), T.P.DASHES, "-")
    x = F.regexp_replace(F.regexp_replace(x, T.P.SPACES, " "), r"\n{3,}", "\n\n")
    canonical = plain_strip(F.array_join(F.transform(F.split(x, "\n", -1), plain_strip), "\n"))
    appeal = F.regexp_extract(c, CT.APPEAL, 0)
    laws = F.regexp_extract_all(c, F.lit(CT.LAW_REFERENCE), F.lit(0))
    found = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(CT.LAW_CLAUSE), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(CT.LAW_REFERENCE), F.lit(0))))
    pairs = {
        "strip": (plain_strip(c), T.strip(c)),
        "canonical": (canonical, T.canonical(c)),
        "appeal": (appeal, F.regexp_extract(F.regexp_extract(c, CT.APPEAL_CLAUSE, 1), CT.APPEAL, 0)),
        "hearing": (F.regexp_extract(c, CT.HEARING, 0), F.regexp_extract(F.regexp_extract(c, CT.HEARING_CLAUSE, 1), CT.HEARING, 0)),
        "laws": (laws, found),
        "roles": (F.array_distinct(F.transform(CT.party_array(c), lambda p: p["role"])), CT.role_array(c)),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    unequal = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()]).first().asDict()
    assert unequal == dict.fromkeys(pairs, 0)
    some = df.agg(F.count_if(appeal != ""), F.count_if(F.size(laws) > 0)).first()
    assert min(some) > 20
