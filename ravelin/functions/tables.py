"""Word lists and tables of the two normalizers."""

# They must be equal to those of the engine whose results are matched.

LEGAL_SUFFIXES = ("pvt", "private", "ltd", "limited", "llc", "llp", "inc", "incorporated", "corp", "corporation", "co", "company", "plc")

ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane", "dr": "drive", "apt": "apartment",
    "ste": "suite", "fl": "floor", "bldg": "building", "opp": "opposite", "nr": "near", "marg": "road", "nagar": "nagar", "h": "house",
}
HOUSE_WORDS = ("hno", "h", "no", "number")

COUNTRY_ALIASES = {
    "usa": "united states", "u s a": "united states", "united states of america": "united states", "us": "united states", "u s": "united states",
    "america": "united states", "bharat": "india", "hindustan": "india", "in": "india", "fr": "france", "fra": "france",
    "french republic": "france", "republique francaise": "france",
}

FULL_LEGAL_SUFFIXES = (
    "corporation", "incorporated", "limited", "private", "company", "llc", "llp", "inc", "corp", "ltd", "pvt", "co", "enterprises", "enterprise",
    "industries", "industry", "services", "solutions", "systems", "technologies", "technology", "associates", "partners", "holdings", "group",
    "traders", "trading",
)

NAME_EXPANSIONS = {
    "corp": "corporation", "corpn": "corporation", "inc": "incorporated", "incorp": "incorporated", "ltd": "limited", "pvt": "private",
    "pvtltd": "private limited", "llc": "limited liability company", "llp": "limited liability partnership", "co": "company",
    "mfg": "manufacturing", "mgf": "manufacturing", "ent": "enterprises", "enterprizes": "enterprises", "intl": "international",
    "assoc": "associates", "assn": "association", "dept": "department", "govt": "government", "tech": "technologies", "technol": "technologies",
}

ADDRESS_EXPANSIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "pl": "place",
    "pkwy": "parkway", "hwy": "highway", "fl": "floor", "bldg": "building", "ste": "suite", "apt": "apartment", "opp": "opposite", "nr": "near",
    "dist": "district", "tal": "taluk", "tq": "taluk", "marg": "road",
}

DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ं": "n", "ः": "h",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh",
    "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y",
    "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "्": "", "ा": "a", "ि": "i", "ी": "ii", "ु": "u",
    "ू": "uu", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ृ": "ri",
}

#: The second table where it differs from the first.
DEVANAGARI_WIDE = DEVANAGARI | {
    "ङ": "ng", "च": "ch", "छ": "chh", "ञ": "ny", "ळ": "l", "ा": "aa", "ं": "m", "ँ": "n", "ॉ": "o", "़": "", "।": " ", "॥": " ",
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}
DEVANAGARI_WIDE.pop("ृ")
