"""Fixed values of the text rules: code-point classes, letter tables, word lists and patterns."""

# The apostrophe code points, the space class and the dash class.
APOSTROPHES = "'‘’ʻʼ`´′"
TURNED_COMMA, MODIFIER_APOSTROPHE = "ʻ", "ʼ"
SPACES = "[ \\t\\u00A0\\u2000-\\u200B\\uFEFF]+"
DASHES = "[\\u2010-\\u2015\\u2212]"

# Cyrillic letters written with several Latin ones, in the order they are replaced.
SEVERAL_LETTERS = [
    ("ьо", "yo"), ("Ў", "Oʻ"), ("ў", "oʻ"), ("Ғ", "Gʻ"), ("ғ", "gʻ"), ("Щ", "Shch"), ("щ", "shch"), ("Ч", "Ch"), ("ч", "ch"), ("Ш", "Sh"),
    ("ш", "sh"), ("Ё", "Yo"), ("ё", "yo"), ("Ю", "Yu"), ("ю", "yu"), ("Я", "Ya"), ("я", "ya"), ("Ц", "Ts"), ("ц", "ts"),
]
# Cyrillic letters written with one Latin letter, and those left out.
ONE_LETTER_FROM = "АаБбВвГгДдЕеЖжЗзИиЙйКкҚқЛлМмНнОоПпРрСсТтУуФфХхҲҳЪъЭэЫы"
ONE_LETTER_TO = "AaBbVvGgDdEeJjZzIiYyKkQqLlMmNnOoPpRrSsTtUuFfXxHhʼʼEeIi"
LEFT_OUT = "Ьь"

# Groups of Latin letters written with one Cyrillic letter, the longest first, and single letters.
LATIN_GROUPS = [
    ("Shch", "Щ"), ("shch", "щ"), ("Oʻ", "Ў"), ("oʻ", "ў"), ("Gʻ", "Ғ"), ("gʻ", "ғ"), ("Ch", "Ч"), ("CH", "Ч"), ("ch", "ч"), ("Sh", "Ш"), ("SH", "Ш"), ("sh", "ш"),
    ("Yo", "Ё"), ("YO", "Ё"), ("yo", "ё"), ("Yu", "Ю"), ("YU", "Ю"), ("yu", "ю"), ("Ya", "Я"), ("YA", "Я"), ("ya", "я"), ("Ts", "Ц"), ("TS", "Ц"), ("ts", "ц"),
]
LATIN_LETTERS = "AaBbVvGgDdEeJjZzIiYyKkQqLlMmNnOoPpRrSsTtUuFfXxHh"
CYRILLIC_LETTERS = "АаБбВвГгДдЕеЖжЗзИиЙйКкҚқЛлМмНнОоПпРрСсТтУуФфХхҲҳ"
# Dictionaries that tell languages, apostrophes left out.
UZBEK_DICTIONARY = [
    "va", "bilan", "uchun", "boyicha", "qanday", "qanaqa", "qilish", "kerak", "mumkin", "men", "mening", "meni", "menga", "siz", "sizning", "nima", "nimaga",
    "qachon", "qayerda", "qaysi", "necha", "qancha", "haqida", "togrisida", "yoki", "ammo", "lekin", "agar", "shartnoma", "ariza", "sud", "qonun", "huquq",
    "hujjat", "ish", "ishdan", "javobgarlik", "majburiyat", "tolov", "muddat", "bor", "yoq", "boladi", "qildim", "qilaman", "yozing", "tushuntiring", "salom",
    "rahmat", "iltimos", "yordam", "savol", "javob", "ҳақида", "керак", "мумкин", "шартнома", "суд", "қонун", "ҳуқуқ", "ариза",
]
RUSSIAN_DICTIONARY = [
    "и", "в", "не", "на", "что", "как", "мне", "мой", "моя", "я", "вы", "ваш", "это", "для", "или", "если", "но", "также", "быть", "есть", "нет", "договор", "суд",
    "закон", "право", "заявление", "иск", "документ", "ответственность", "обязательство", "срок", "оплата", "работник", "здравствуйте", "спасибо", "пожалуйста",
    "помогите", "вопрос", "можно",
]
ENGLISH_DICTIONARY = [
    "the", "and", "is", "are", "of", "to", "in", "for", "on", "with", "a", "an", "how", "what", "when", "where", "which", "can", "should", "must", "my", "i",
    "contract", "law", "court", "claim", "document", "employee", "employer", "liability", "obligation", "hello", "thanks", "please", "help", "question",
]

# Words that mark Russian.
RUSSIAN_WORDS = [
    "что", "это", "который", "которая", "также", "если", "быть", "может", "должен", "должна", "настоящего", "соответствии",
    "является", "статья", "статьи", "закон", "кодекс", "договор", "лицо", "лица", "случае", "порядке", "течение",
]

# Words that carry no content, and case endings in the order they are tried.
STOP_WORDS = [
    "va", "yoki", "ham", "bu", "shu", "bir", "uchun", "bilan", "lekin", "ammo", "agar", "chunki", "hamda", "ya'ni", "kabi", "qilib", "qilish",
    "bo'lgan", "bo'ladi", "bo'lsa", "emas", "ega", "har", "hech", "faqat", "ushbu", "mazkur", "o'z", "ular", "biz", "siz", "men", "keyin",
    "oldin", "ko'ra", "asosan", "holda", "tomonidan",
]
SUFFIXES = ["larining", "lariga", "larida", "laridan", "larini", "larning", "sining", "siga", "sida", "sidan", "sini", "ning", "lar", "ga", "da", "dan", "ni", "si", "i"]
LEAST_STEM, LEAST_WORD = 4, 4

# How months begin, Uzbek and Russian, in the order they are tried.
MONTHS = [
    ("yanvar", 1), ("fevral", 2), ("mart", 3), ("aprel", 4), ("may", 5), ("iyun", 6), ("iyul", 7), ("avgust", 8), ("sentabr", 9), ("oktabr", 10),
    ("noyabr", 11), ("dekabr", 12), ("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("май", 5), ("июн", 6), ("июл", 7), ("август", 8),
    ("сентябр", 9), ("октябр", 10), ("ноябр", 11), ("декабр", 12), ("янв", 1), ("фев", 2), ("мар", 3), ("апр", 4), ("сен", 9), ("окт", 10),
    ("ноя", 11), ("дек", 12),
]

# Patterns of article numbers, tried in this order.
ARTICLE_NUMBER = [
    r"(?iu)(\d+(?:\s*[-–]\d+)?)\s*[-–]?\s*modda",
    r"(?iu)(\d+(?:\s*[-–]\d+)?)\s*[-–]?\s*модда",
    r"(?iu)стать[яи]\s+(\d+(?:[-–.]\d+)?)",
    r"^\s*(\d+(?:\s*[-–]\d+)?)\s*[-–.]",
]
LONGEST_ARTICLE_RANGE = 60

# Query kinds and shorthand of codes.
ARTICLE_REFERENCE = r"(?iu)\b\d{1,4}\s*[-–]?\s*(?:modda|модда)|стать[яи]\s*\d+"
ARTICLE_IN_QUERY = r"(?iu)(?:\b(\d{1,4})\s*[-–]?\s*(?:modda|модда)|стать[яи]\s*(\d{1,4}))"
ANALYTICAL = r"(?iU)\b(mumkinmi|bo['ʻ]ladimi|haqlimi|haqiqiymi|kim\s+haq|qanday\s+himoya|oqibat|javobgar\w*mi|можно\s+ли|вправе\s+ли)"
PROCEDURAL = r"(?iU)\b(muddat|tartib|ariza|shikoyat|apellyatsiya|kassatsiya|sud\w*\s+murojaat|protsessual|срок|порядок|жалоб|апелляц)"
CODE_SHORTHAND = {
    "fk": "fuqarolik kodeksi", "гк": "fuqarolik kodeksi", "mk": "mehnat kodeksi", "тк": "mehnat kodeksi", "jk": "jinoyat kodeksi",
    "ук": "jinoyat kodeksi", "jpk": "jinoyat-protsessual kodeksi", "fpk": "fuqarolik protsessual kodeksi", "ok": "oila kodeksi",
    "sk": "soliq kodeksi", "mjtk": "ma'muriy javobgarlik",
}
CODE_WORDS = ["fuqarolik", "mehnat", "jinoyat", "oila", "soliq", "yer", "uy-joy"]

# Number words, and the units that make a quantity.
NUMBER_WORDS_ONES = {"bir": 1, "ikki": 2, "uch": 3, "to'rt": 4, "tort": 4, "besh": 5, "olti": 6, "yetti": 7, "sakkiz": 8, "to'qqiz": 9, "toqqiz": 9}
NUMBER_WORDS_TENS = {"o'n": 10, "on": 10, "yigirma": 20, "o'ttiz": 30, "ottiz": 30, "qirq": 40, "ellik": 50, "oltmish": 60, "yetmish": 70, "sakson": 80, "to'qson": 90, "yuz": 100, "ming": 1000}
QUANTITY_UNITS = {
    "yil": "yil", "yilgacha": "yil", "yildan": "yil", "oy": "oy", "oygacha": "oy", "oydan": "oy", "kun": "kun", "kungacha": "kun", "kundan": "kun",
    "hafta": "hafta", "soat": "soat", "foiz": "foiz", "foizdan": "foiz", "barobar": "barobar", "baravar": "barobar", "marta": "marta",
    "yosh": "yosh", "yoshdan": "yosh", "yoshga": "yosh",
}

# What makes a claim legal.
LEGAL_MARKERS = (
    r"(?U)\b(modda\w*|kodeks\w*|qonun\w*|farmon\w*|nizom\w*|plenum\w*|band\w*|qism\w*|norma\w*|qaror\w*|hujjat\w*|huquq\w*|majburiyat\w*|javobgar\w*|"
    r"jarima\w*|sanksiya\w*|sanktsiya\w*|da'vo\w*|sud\w*|shartnoma\w*|mulk\w*|meros\w*|nafaqa\w*|soliq\w*|muddat\w*|ariza\w*|shikoyat\w*|"
    r"apellyatsiya\w*|kassatsiya\w*|belgilan\w*|nazarda\s+tutil\w*|taqiqlan\w*|ruxsat\s+etil\w*|majbur\w*|haqli\w*|bekor\s+qilin\w*|amal\s+qilad\w*)\b"
)
CITATION_TAG = r"(?i)\[\s*(C\d{1,3})\s*\]"
