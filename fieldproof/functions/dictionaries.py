"""Fixed values the checks are defined by: scripts, markers, months and aliases.

These tables are given data, not logic; results depend on their exact content.
"""

from __future__ import annotations

# Languages with a rule of their own.
TASK_LANGUAGES = ["bo", "id", "ja", "kk-Arab", "mn-Mong", "th", "ug", "zh"]
LANGUAGES = [*TASK_LANGUAGES, "en"]
ROLES = ["entity", "immutable", "semantic", "status"]
METHODS = ["extract_localize_verify", "field_constrained", "naive", "protected_slot_realization"]
POLICIES = ["relaxed", "strict"]

# Character ranges of scripts.
HAN = r"\x{4e00}-\x{9fff}"
KANA = r"\x{3040}-\x{30ff}"
THAI = r"\x{0e00}-\x{0e7f}"
TIBETAN = r"\x{0f00}-\x{0fff}"
ARABIC = r"\x{0600}-\x{06ff}"
MONGOLIAN = r"\x{1800}-\x{18af}"
CYRILLIC = r"\x{0400}-\x{052f}"

# Words of which an Indonesian answer holds at least one.
INDONESIAN_MARKERS = [
    "adalah", "berikut", "bumi", "dari", "dengan", "ditinjau", "gempa", "hasil", "informasi", "kekuatan", "kode", "lisensi",
    "lokasi", "menurut", "negara", "pada", "paket", "pendapatan", "repositori", "terjadi", "telah", "untuk", "versi", "wilayah",
    "waktu", "alat", "menunjukkan", "record", "produk", "buku", "cuaca", "tanggal", "penerbit", "judul", "hari", "libur", "jumlah",
    "diterbitkan", "ditemukan", "maksimum",
]
# Strings of which a Uyghur answer holds at least one.
UYGHUR_MARKERS = [
    "نىڭ", "بۇ", "كۈنى", "مەھسۇلات", "نەتىجىسى", "چۈشەندۈر", "كىتاب", "تۈرى", "ھەققىدە", "تۆۋەندىكى", "ئۇچۇرلار", "تەمىنلەندى",
    "ئىشلىتىلگەن", "نەشرى", "مەنبە", "لىتسېنزىيە",
]
# Strings of which a Kazakh answer holds at least two; each counts by itself.
KAZAKH_MARKERS = [
    "اقىبارات", "اقىباراتتى", "اتى", "اتاۋى", "اۋا رايى", "ايماعى", "استاناسى", "باسپاسى", "بەت", "بەت سانى", "بويلىق", "بويىنشا",
    "جازباسى", "جاعدايى", "جاريا", "جاۋىن", "جالپى", "جىلى", "دەم الىس", "دەڭگەيى", "قۇرال", "كورسەتەدى", "كورسەتىلگەن", "كودى",
    "كۇشى", "كۇنى", "كەڭدىك", "كىرىس", "كىتاپ", "ناتيجەسى", "نۇسقا", "نۇسقاسى", "سانى", "تاۋار", "تالابى", "تارماعى", "تۋرالى",
    "تۋرى", "تۇسىندىرىڭىز", "تىلى", "ورنى", "ۋاقىت", "ەلدىڭ",
]
KAZAKH_LEAST = 2
ENGLISH_LEAST_WORDS = 3

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
# Further decimal digits that count as digits in dates.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹༠༡༢༣༤༥༦༧༨༩᠐᠑᠒᠓᠔᠕᠖᠗᠘᠙०१२३४५६७८९০১২৩৪৫৬৭৮৯"

# Month names of English, Indonesian and Thai by number.
MONTH_NAMES = {
    1: ["january", "jan", "januari", "มกราคม"],
    2: ["february", "feb", "februari", "กุมภาพันธ์"],
    3: ["march", "mar", "maret", "มีนาคม"],
    4: ["april", "apr", "เมษายน"],
    5: ["may", "mei", "พฤษภาคม"],
    6: ["june", "jun", "juni", "มิถุนายน"],
    7: ["july", "jul", "juli", "กรกฎาคม"],
    8: ["august", "aug", "agustus", "สิงหาคม"],
    9: ["september", "sep", "กันยายน"],
    10: ["october", "oct", "oktober", "ตุลาคม"],
    11: ["november", "nov", "พฤศจิกายน"],
    12: ["december", "dec", "desember", "ธันวาคม"],
}
MONTHS = {name: number for number, names in MONTH_NAMES.items() for name in names}
BUDDHIST_FROM, BUDDHIST_OFFSET = 2400, 543

# What a raw value may be called in a language.
VALUE_ALIASES = {
    ("moderate drizzle", "zh"): ["中度毛毛雨", "中度细雨", "中等细雨"],
    ("product found", "zh"): ["产品已找到", "已找到产品", "找到产品"],
    ("public", "zh"): ["公开", "公共"],
    ("public", "id"): ["publik", "umum"],
    ("public", "th"): ["สาธารณะ"],
    ("true", "zh"): ["是", "全国性节假日", "全国性的节假日"],
    ("true", "id"): ["ya", "benar"],
    ("true", "th"): ["ใช่"],
    ("public holiday", "zh"): ["公共假日", "公众假日", "公共节假日", "公共假期"],
    ("public holiday", "id"): ["hari libur umum", "libur publik", "hari libur publik"],
    ("public holiday", "th"): ["วันหยุดราชการ", "วันหยุดสาธารณะ"],
    ("journal-article", "zh"): ["期刊文章", "期刊论文"],
    ("journal-article", "ja"): ["ジャーナル記事", "論文誌記事"],
    ("journal-article", "th"): ["บทความวารสาร", "บทความในวารสาร"],
    ("journal-article", "id"): ["artikel jurnal", "artikel dalam jurnal"],
    ("reviewed", "zh"): ["已审查", "已审核", "已复核"],
    ("reviewed", "ja"): ["レビュー済み", "確認済み"],
    ("reviewed", "th"): ["ตรวจสอบแล้ว", "ได้รับการตรวจสอบ"],
    ("reviewed", "id"): ["ditinjau", "telah ditinjau", "sudah ditinjau"],
    ("high income", "zh"): ["高收入"],
    ("high income", "ja"): ["高所得"],
    ("high income", "th"): ["รายได้สูง"],
    ("high income", "id"): ["pendapatan tinggi"],
}
# A value that takes the aliases of another at one path.
PATH_ALIASES = {("public", "holidayTypes"): "public holiday"}

# What a code may be called.
COUNTRY_CODES = {
    "CN": ["China", "中国", "中华人民共和国", "中國", "中国の", "จีน", "Tiongkok", "Cina", "རྒྱ་ནག", "جۇڭگو", "ᠳᠤᠮᠳᠠᠳᠤ", "قىتاي"],
    "JP": ["Japan", "日本", "日本の", "ญี่ปุ่น", "Jepang", "ཉི་ཧོང", "ياپونىيە", "ᠶᠠᠫᠣᠨ", "ياپون"],
    "ID": ["Indonesia", "印尼", "印度尼西亚", "インドネシア", "อินโดนีเซีย", "ཨིན་ཌོ་ནེ་ཤི་ཡ", "ھىندونېزىيە", "ᠢᠨᠳᠣᠨᠧᠽ", "ىندونەزىيە"],
    "US": [
        "United States", "United States of America", "USA", "America", "美国", "美國", "米国", "アメリカ", "สหรัฐอเมริกา", "Amerika Serikat",
        "ཨ་མེ་རི་ཁ", "ئامېرىكا", "ᠠᠮᠧᠷᠢᠺᠠ", "امەريكا",
    ],
    "MN": ["Mongolia", "蒙古", "モンゴル", "มองโกเลีย", "སོག་པོ", "موڭغۇلىيە", "ᠮᠣᠩᠭᠣᠯ", "موڭعوليا"],
}
CURRENCY_CODES = {
    "usd": [
        "USD", "US dollar", "U.S. dollar", "United States dollar", "dollar", "美元", "米ドル", "ดอลลาร์สหรัฐ", "dolar AS", "dolar Amerika",
        "ཨ་རིའི་སྒོར་མོ", "ئامېرىكا دوللىرى", "ᠠᠮᠧᠷᠢᠺᠠ ᠳ᠋ᠣᠯᠯᠠᠷ", "امەريكا دوللىرى",
    ],
}
LANGUAGE_CODES = {
    "en": ["English", "英语", "英文", "英語", "ภาษาอังกฤษ", "bahasa Inggris", "Inggris", "དབྱིན་སྐད", "ئىنگلىزچە", "ᠠᠩᠭᠯᠢ", "اعىلшын"],
}
# The paths whose codes may be copied or localised.
COUNTRY_PATHS = ["countryCode", "country_code", "iso2Code", "iso2_code", "alpha_two_code"]
CURRENCY_PATH, LANGUAGE_PATH = "currency", "language"
