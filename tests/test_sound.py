"""Sound keys against literal ones, and the sound-alike branch of the alias search."""

import pytest
from pyspark.sql import functions as F

from dutymark.functions import sound
from dutymark.operators import similarity as S

#: word: first and second key of double metaphone.
DOUBLE = {
    "Accident": ("AKST", "AKST"), "Arnow": ("ARN", "ARNF"), "Bacchus": ("PKS", "PKS"), "Bajador": ("PJTR", "PHTR"), "Biaggi": ("PJ", "PK"), "Breaux": ("PR", "PR"), "Cabrillo": ("KPRL", "KPR"), "Caesar": ("SSR", "SSR"),
    "Cagney": ("KKN", "KKN"), "Campbell": ("KMPL", "KMPL"), "Character": ("KRKT", "KRKT"), "Chianti": ("KNT", "KNT"), "Church": ("XRX", "XRK"), "Czar": ("SR", "XR"), "Dumb": ("TM", "TM"), "Edge": ("AJ", "AJ"),
    "Edgar": ("ATKR", "ATKR"), "Filipowicz": ("FLPT", "FLPF"), "Focaccia": ("FKX", "FKX"), "Gallegos": ("KLKS", "KKS"), "Ghislane": ("JLN", "JLN"), "Gnome": ("NM", "NM"), "Hochmeier": ("HKMR", "HKMR"), "Hugh": ("H", "H"),
    "Island": ("ALNT", "ALNT"), "Jose": ("HS", "HS"), "Knight": ("NT", "NT"), "Laugh": ("LF", "LF"), "Matthew": ("M0", "MTF"), "McClellan": ("MKLL", "MKLL"), "Michael": ("MKL", "MXL"), "Nation": ("NXN", "NXN"),
    "Orchestra": ("ARKS", "ARKS"), "Paneer": ("PNR", "PNR"), "Pizza": ("PS", "PTS"), "Raspberry": ("RSPR", "RSPR"), "Rogier": ("RJ", "RJR"), "Schermerhorn": ("XRMR", "SKRM"), "Schmidt": ("XMT", "SMT"),
    "School": ("SKL", "SKL"), "Smith": ("SM0", "XMT"), "Snider": ("SNTR", "XNTR"), "Sugar": ("XKR", "SKR"), "Tagliaro": ("TKLR", "TLR"), "Thomas": ("TMS", "TMS"), "Thumb": ("0M", "TM"), "Tough": ("TF", "TF"),
    "Uomo": ("AM", "AM"), "Wasserman": ("ASRM", "FSRM"), "Wright": ("RT", "RT"), "Xavier": ("SF", "SFR"), "Zhao": ("J", "J"), "": ("", ""), "12": ("", ""), "O'Hara": ("AHR", "AHR"),
}
METAPHONE = {
    "Aeon": "EN", "Black": "BLK", "Cell": "SL", "Chemical": "XMKL", "Christ": "KRST", "Dumbo": "TM", "Dodgy": "TJ", "Ghost": "FST", "Gumbo": "KM", "Knob": "NB", "Logic": "LJK", "Loch": "LX", "Paani": "PN", "Panee": "PN",
    "Panneer": "PNR", "Phone": "FN", "Pneumatic": "NMTK", "Queen": "KN", "Quick": "KK", "School": "SKL", "Science": "SNS", "Sign": "SN", "Signed": "SNT", "Special": "SPXL", "Station": "STXN", "Thyme": "0M", "Vodka": "FTK",
    "Whale": "WL", "Wrist": "RST", "Xylem": "SLM", "Yellow": "YL", "Biscuits": "BSKTS", "Refrigerator": "RFRJRT", "": "",
}


@pytest.mark.parametrize("word", DOUBLE)
def test_double_metaphone(word):
    assert sound.double_metaphone(word) == DOUBLE[word]


@pytest.mark.parametrize("word", METAPHONE)
def test_metaphone(word):
    assert sound.metaphone(word) == METAPHONE[word]


def test_keys_as_columns(spark):
    rows = spark.createDataFrame([(w,) for w in (*DOUBLE, None)], "w string").withColumn("s", sound.sound_keys(F.col("w"))).collect()
    for r in rows:
        assert tuple(r["s"]) == ((None, None, None) if r["w"] is None else (sound.metaphone(r["w"]), *DOUBLE[r["w"]]))


def test_sound_alike_words_take_the_lower_floor(spark):
    aliases = spark.createDataFrame([("pani", "water", 1.0), ("panner", "cheese", 1.0), ("panyr", "far", 9.0), ("the", "article", 1.0), ("chapli", "slipper", 1.0), ("chapli", "shoe", 1.0)], "term string, english string, weight double")
    queries = spark.createDataFrame([(1, "Paani Paneer"), (2, "the PANI thee"), (3, "unknown"), (4, ""), (5, None), (6, "chapli chapli")], "query_id long, text string")
    got = {r["query_id"]: r["expanded"] for r in S.expand_query(queries, aliases).collect()}
    # paani and pani share 4 of 8 trigrams; thee and the 3 of 6; paneer is like panner and sounds like panyr (3 of 9: under the lower floor)
    assert got == {1: "water cheese", 2: "article water article", 3: "unknown", 6: "shoe shoe"}
    near = {(r["word"], r["term"]) for r in S.similar_terms(spark.createDataFrame([("cold",), ("ring",)], "word string"), spark.createDataFrame([("colt", "x", 1.0), ("rink", "y", 1.0), ("rins", "z", 1.0)], "term string, english string, weight double")).collect()}
    assert near == {("cold", "colt"), ("ring", "rink")}
