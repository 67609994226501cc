"""Fixed values of the tariff domain: patterns, word lists and rates that results depend on."""

# Tax slabs in percent.
SLABS = (0.0, 0.1, 0.25, 1.5, 3.0, 5.0, 12.0, 18.0, 28.0)

# Chapters and code prefixes on which cess is likely.
CESS_CHAPTERS = ("22", "24", "27", "87")

# Codes that stand for "unclassified".
PLACEHOLDERS = ("99999999", "00000000")

# Rate of an alias of the corpus by its chapter, and of all other chapters.
ALIAS_RATES = {"19": 18.0, "21": 18.0, "20": 12.0}
ALIAS_RATE = 5.0

# Amended codes (old, new, effective date, reference).
AMENDMENTS = (
    ("21069099", "19019090", "2022-07-13", "GST Council 47th meeting, Notification 6/2022-CT(Rate)"),
    ("21069011", "21069099", "2022-07-13", "GST Council 47th meeting"),
    ("04015000", "04011000", "2022-01-01", "GST Council 45th meeting"),
)

# Default rate of each chapter, chapters 01 to 99 in order.
CHAPTER_RATES = (
    0, 0, 5, 5, 0, 5, 0, 0, 0, 0, 0, 0, 5, 0, 5, 12, 5, 18, 18, 12, 18, 18, 0, 28, 5, 5, 5, 18, 18, 12, 5, 18, 18,
    18, 18, 18, 18, 18, 18, 12, 5, 12, 12, 12, 12, 12, 12, 12, 12, 5, 5, 5, 5, 5, 5, 5, 5, 5, 12, 5, 5, 5, 5, 12, 12, 12,
    12, 12, 12, 18, 3, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18, 12, 28, 18, 5, 12, 18, 18, 12, 18, 18, 18, 12, 5, 0,
)

# Invoice typos, replaced in this order as whole words.
TYPOS = (
    (r"\bCOCUNUT\b", "COCONUT"), (r"\bP\s*\.?\s*COCONUT\b", "P COCONUT"), (r"\bREFIL\b", "REFILL"), (r"\bCOMPUND\b", "COMPOUND"), (r"\bBIKIS\b", "BISCUIT"),
    (r"\bSURF\s+EXCEL\b", "SURF EXCEL"), (r"\bEASY\s+WASH\b", "EASY WASH"), (r"\bAASHIRWAD\b", "AASHIRVAAD"), (r"\bCLINIC\s*\+\b", "CLINIC PLUS"),
    (r"\bMILK\s+BIKIS\b", "MILK BIKIS"), (r"\bPARLE\s*G\b", "PARLE G"), (r"\bUDHAYAM\b", "UDAYAM"), (r"\bVELLAM\b", "JAGGERY"), (r"\bSHARKARA\b", "JAGGERY"),
    (r"\bMATTA\s+RICE\b", "MATTA RICE"), (r"\bRICE\s+MATTA\b", "MATTA RICE"), (r"\bTOOR\s+DAL\b", "TOOR DAL"), (r"\bAPPAM\s+PODI\b", "APPAM PODI"),
    (r"\bCHEMMEEN\s+ACHAR\b", "PICKLED PRAWN"), (r"\bBANANA\s+CHIPS\b", "BANANA CHIPS"),
)

# Point-of-sale abbreviations that count anywhere as a whole word.
ABBREVIATIONS = {
    "BTL": "BOTTLE", "PCH": "POUCH", "PKT": "PACKET", "SCH": "SACHET", "SACH": "SACHET", "HDPE": "HDPE BOTTLE", "GLASS": "GLASS BOTTLE", "PDR": "POWDER", "PWD": "POWDER",
    "POWD": "POWDER", "LQD": "LIQUID", "LIQ": "LIQUID", "CRM": "CREAM", "SPR": "SPRAY", "OINT": "OINTMENT", "SYP": "SYRUP", "INJ": "INJECTION", "SUSP": "SUSPENSION",
    "SOL": "SOLUTION", "SHP": "SHAMPOO", "CDNR": "CONDITIONER", "DTG": "DETERGENT", "DSH": "DISHWASH", "FLR": "FLOOR CLEANER", "DEO": "DEODORANT", "PRF": "PERFUME",
    "FCWSH": "FACE WASH", "SCRB": "SCRUB", "MST": "MOISTURISER", "SNSCRN": "SUNSCREEN", "LIP": "LIP BALM", "HCRM": "HAIR CREAM", "HOIL": "HAIR OIL", "HGEL": "HAIR GEL",
    "TNR": "TONER", "CRTG": "CARTRIDGE", "RIBBN": "RIBBON", "TOOTHPDR": "TOOTH POWDER", "BIB": "BISCUIT", "CHOC": "CHOCOLATE", "COF": "COFFEE", "CHAI": "TEA",
    "NOOD": "NOODLES", "VERM": "VERMICELLI", "NAMK": "NAMKEEN", "MSL": "MASALA", "MSAL": "MASALA", "SUGR": "SUGAR", "VINGR": "VINEGAR", "CHUT": "CHUTNEY", "PICK": "PICKLE",
    "KCHP": "KETCHUP", "MUST": "MUSTARD", "CHPL": "CHAPPAL", "SNDL": "SANDAL", "SLPR": "SLIPPER", "KTCHN": "KITCHEN", "CKWR": "COOKWARE", "PRSCKR": "PRESSURE COOKER",
    "MBL": "MOBILE", "CHRGR": "CHARGER", "EARPH": "EARPHONE", "HDPH": "HEADPHONE", "PNDRV": "PEN DRIVE", "MEMCRD": "MEMORY CARD", "LPTP": "LAPTOP", "TBLT": "TABLET",
    "CABL": "CABLE", "ADPTR": "ADAPTER", "GRMT": "GARMENT", "FBRC": "FABRIC", "SHRT": "SHIRT", "DPR": "DIAPER", "NTBK": "NOTEBOOK", "NOTEBK": "NOTEBOOK", "FLDR": "FOLDER",
    "STAPL": "STAPLER", "SCSSR": "SCISSORS",
}

# Abbreviations that count only before a blank or the end.
END_ABBREVIATIONS = {
    "PET": "PET BOTTLE", "LOT": "LOTION", "TAB": "TABLET", "CAP": "CAPSULE", "CRT": "CARTRIDGE", "CHO": "CHOCOLATE", "ATT": "ATTA", "DL": "DAL", "RIC": "RICE", "SLT": "SALT",
    "SHO": "SHOE", "WHT": "WHEAT", "PNT": "PANT",
}

# Units and shapes that make a size.
NOISE_UNITS = "KG|GMS|GM|G|ML|LTR|LT|L|PCS|NOS|MTR|M|CM|MM|FT|IN|OZ|LB"
KEY_UNITS = "G|GM|GMS|KG|KGS|ML|L|LTR|LITRE|LITER|PC|PCS|NOS|NO|N|P|IN|MG|OZ|LB"
PACK_UNITS = "ML|L|LTR|G|GM|KG"
TOKEN_UNITS = "ml|g|gm|kg|l|ltr|mg|oz|lb|pc|pcs|nos"

SHAPES = (r"\b\d+\s*X\s*\d+\b", r"\b\d+\s*\+\s*\d+\b", r"\b\d+[SNP]\b")

# Words that open a name without meaning.
LEADING_STOPS = ("THE", "A", "AN", "AND", "WITH", "FOR", "OF", "IN", "AT", "BY")

# Words that say nothing about the product.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "in", "is", "for", "to", "with", "on", "at", "by", "from", "are", "was", "be", "as", "it", "its", "this", "that", "per", "ml", "gm", "kg", "ltr",
    "litre", "liter", "gram", "mg", "unit", "pack", "piece", "nos", "no", "pcs", "set", "box", "bottle", "pouch", "sachet", "can", "tin", "jar", "tube", "strip", "tablet", "capsule",
    "pkt", "packet", "roll", "sheet", "size", "new", "free", "buy", "get", "pure", "natural", "original", "brand", "best", "premium", "super", "small", "large", "medium", "big",
    "regular", "extra", "special", "standard", "quality", "type", "model", "cover", "weight", "net", "gross",
)

# Brand words (a short default list; pass a table for more).
BRANDS = (
    "patanjali", "nestle", "amul", "tata", "godrej", "dettol", "lifebuoy", "colgate", "pepsodent", "nivea", "garnier", "loreal", "sony", "samsung", "apple", "lg", "whirlpool", "philips",
    "bajaj", "marico", "unilever", "parle", "britannia", "honda", "suzuki", "vkc", "cb",
)

# Trade abbreviations of the token dictionary.
TRADE_WORDS = {"btrm": "bathroom", "clnr": "cleaner", "shmp": "shampoo", "conc": "concentrate", "loc": "local", "dom": "domestic", "froz": "frozen", "florl": "floral", "shavng": "shaving", "razr": "razor", "wmn": "women", "pck": "pack", "pkt": "packet"}

# Synonyms of tokens, in order.
SYNONYMS = {"jaggery": ("gur", "vellam"), "rice": ("paddy", "matta"), "soap": ("detergent", "toilet"), "oil": ("gingelly", "fat"), "shoe": ("footwear", "chappal"), "tea": ("chai",)}

# Rates of category rules (rule number, keyword, allowed chapters).
CATEGORY_RULES = ((1, "gear", ("84", "87")), (2, "anvil", ("82",)), (3, "ring", ("71", "73")), (4, "rod", ("72", "95")), (5, "plate", ("69", "72")))

# Lists of source weights.
SOURCE_PRIORITY = {"verified_exact": 1.0, "correct_datas": 0.9, "product_batch": 0.8, "hsn_codes": 0.5}
LAYER_BONUS = {"L6_verified_products": 0.18, "L2_inverted_index": 0.10, "L4_faiss_semantic": 0.08, "L3_pg_trgm_fuzzy": 0.05}

# Latin spellings that mark romanized Malayalam.
ROMAN_HINTS = ("vellam", "sharkara", "chemmeen", "achar", "podi", "matta", "appam", "puttu", "kappa", "chakka")

#: Words that get no similar alias.
UNRESOLVED = ("the", "and", "for", "with", "from", "size", "pack", "kg", "gm", "ml", "ltr", "pcs", "no", "nos", "buy", "get", "new")

#: Units of the sizes that name searches leave out.
NAME_UNITS = "g|kg|ml|l|mg|gm|pc|pcs|nos|pack|tab|tabs|caps"
