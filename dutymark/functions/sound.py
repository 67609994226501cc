"""Sound-alike keys of words: metaphone and double metaphone, as ordered rewrite rules with look-around.

A rule is (pattern, first key, second key[, flag]). At each place of the upper-case word the first rule whose pattern
matches there writes its keys and takes the letters it matched; patterns see the letters before and after. Rules
with a flag hold only for words that have it (or, with -, lack it). The keys follow the published algorithms.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# ---- fixed values: the rules of the two algorithms ----

#: Words of Slavic or Germanic spelling, and those that open with SCH or MC.
FLAGS = {"slavic": "W|K|CZ", "sch": "^SCH", "mc": "^MC"}

METAPHONE = (
    (r"^AE", "E"), (r"^[GKP]N", "N"), (r"^WR", "R"), (r"^WH", "W"), (r"^X", "S"), (r"^[AEIOU]", "="), (r"[AEIOU]", ""), (r"(?!C)(?<=([A-Z]))\1", ""),
    (r"(?<=M)B", ""), (r"B", "B"), (r"C(?=IA)", "X"), (r"(?<=S)C(?=[EIY])", ""), (r"C(?=[EIY])", "S"), (r"CH(?=R)|(?<=S)CH", "K"), (r"CH", "X"), (r"C", "K"),
    (r"DG(?=[EIY])", "J"), (r"D", "T"), (r"(?<=[BDH]..)GH|(?<=H...)GH", ""), (r"GH", "F"), (r"G(?=N$|NED)", ""), (r"(?<!G)G(?=[EIY])", "J"), (r"G", "K"),
    (r"(?<![CGPST])H(?=[AEIOU])", "H"), (r"H", ""), (r"(?<=C)K", ""), (r"PH", "F"), (r"Q", "K"), (r"SH|SCH(?=W)", "X"), (r"S(?=I[OA])", "X"), (r"S", "S"),
    (r"TH", "0"), (r"T(?=I[OA])", "X"), (r"V", "F"), (r"[WY](?=[AEIOU])", "="), (r"[WY]", ""), (r"X", "KS"), (r"Z", "S"), (r"[A-Z]", "="),
)

DOUBLE_METAPHONE = (
    (r"^[GKP](?=N)|^P(?=S)|^W(?=R)", "", ""), (r"^X", "S", "S"), (r"^[AEIOUY]", "A", "A"), (r"[AEIOUY]", "", ""), (r"BB?", "P", "P"),
    (r"(?<=[^AEIOUY]A)CH(?![EI])|(?<=[BM]A)CH(?=ER)", "K", "K"), (r"^CA(?=ESAR)", "S", "S"), (r"CH(?=IA)", "K", "K"), (r"(?!^)CH(?=AE)", "K", "X"),
    (r"^CH(?=ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K", "K"), (r"CH", "K", "K", "sch"), (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[ST])", "K", "K"),
    (r"(?:^|(?<=[AEOU]))CH(?=[BFHLMNRVW]|$)", "K", "K"), (r"^CH", "X", "X"), (r"CH", "K", "K", "mc"), (r"CH", "X", "K"), (r"(?<!WI)CZ", "S", "X"), (r"CCI(?=A)", "X", "X"),
    (r"(?<=^A)CC(?!HU)[EHI]|(?<=U)CCE(?=[ES])", "KS", "KS"), (r"(?<!^M)CC(?!HU)[EHI]", "X", "X"), (r"(?<!^M)CC|C[GKQ]", "K", "K"), (r"CI(?=[AEO])", "S", "X"), (r"C[EIY]", "S", "S"),
    (r"CC(?![EI])|C", "K", "K"), (r"DG[EIY]", "J", "J"), (r"DG", "TK", "TK"), (r"D[DT]?", "T", "T"), (r"FF?", "F", "F"),
    (r"(?<=[^AEIOUY])GH|^GH(?!I)", "K", "K"), (r"^GH", "J", "J"), (r"(?<=[BDH].)GH|(?<=[BDH]..)GH|(?<=[BH]...)GH", "", ""), (r"(?<=[CGLRT].U)GH", "F", "F"), (r"(?<!I)GH", "K", "K"), (r"GH", "", ""),
    (r"(?<=^[AEIOUY])GN", "KN", "N", "-slavic"), (r"GN(?!EY)", "N", "KN", "-slavic"), (r"GN", "KN", "KN"), (r"GL(?=I)", "KL", "L", "-slavic"),
    (r"^G(?:Y|E(?=[BILPRSY])|I(?=[BELN]))", "K", "J"), (r"(?<!^DAN)(?<!^MAN)(?<!^RAN)(?<![EI])GE(?=R)|(?<![EIOR])GY", "K", "J"),
    (r"GE(?=T)", "K", "K"), (r"G[EIY]|(?<=[AO])GG(?=I)", "K", "K", "sch"), (r"GI(?=ER$)", "J", "J"), (r"G[EIY]|(?<=[AO])GG(?=I)", "J", "K"), (r"GG?", "K", "K"),
    (r"(?:^|(?<=[AEIOUY]))H[AEIOUY]", "H", "H"), (r"H", "", ""), (r"^J(?=OSE$)", "H", "H"), (r"J(?=OSE)", "J", "H"), (r"^JJ?", "J", "A"), (r"(?<=[AEIOUY])J(?=[AO])", "J", "H", "-slavic"), (r"J$", "J", ""),
    (r"(?<![KLS])J(?![BKLMNSTZ])J?", "J", "J"), (r"JJ?", "", ""), (r"KK?", "K", "K"), (r"(?<=I)LL(?=[AO]$)|(?<=A)LL(?=E$|E.*[AO]S?$)", "L", ""), (r"LL?", "L", "L"),
    (r"(?<=U)MB(?=$|ER)|MM?", "M", "M"), (r"NN?", "N", "N"), (r"PH", "F", "F"), (r"P[BP]?", "P", "P"), (r"QQ?", "K", "K"), (r"(?<!MEIE)(?<!MAIE)(?<=IE)R$", "", "R", "-slavic"), (r"RR?", "R", "R"),
    (r"(?<=[IY])S(?=L)", "", ""), (r"^S(?=UGAR)", "X", "S"), (r"SH(?=EIM|OEK|OLM|OLZ)", "S", "S"), (r"SH", "X", "X"), (r"SI[AO]", "S", "X", "-slavic"), (r"SI[AO]", "S", "S"),
    (r"SZ|^S(?=[LMNW])", "S", "X"), (r"SCH(?=E[NR])", "X", "SK"), (r"SCH(?=OO|UY|E[DM])", "SK", "SK"), (r"^SCH(?![AEIOUYW])", "X", "S"), (r"SCH", "X", "X"), (r"SC[EIY]", "S", "S"), (r"SC.?", "SK", "SK"),
    (r"(?<=[AO]I)S$", "", "S"), (r"SS?", "S", "S"), (r"TI(?:O(?=N)|A)|TCH", "X", "X"), (r"TH(?=[AO]M)", "T", "T"), (r"TH|TT(?=H)", "T", "T", "sch"), (r"TH|TT(?=H)", "0", "T"), (r"T[DT]?", "T", "T"),
    (r"VV?", "F", "F"), (r"WR", "R", "R"), (r"^WI(?:CZ|TZ)", "ATS", "FFX"), (r"^W(?=[AEIOUY])", "A", "F"), (r"^W(?=H)", "A", "A"), (r"(?<=[AEIOUY])W$|(?<=[EO])W(?=SK[IY])", "", "F"), (r"W", "", "F", "sch"),
    (r"WI(?:CZ|TZ)", "TS", "FX"), (r"W", "", ""), (r"(?<=[AO]U)X$", "", ""), (r"X[CX]?", "KS", "KS"), (r"ZH", "J", "J"), (r"Z(?=Z[AIO])Z?", "S", "TS"), (r"(?<=[^T])ZZ?", "S", "TS", "slavic"), (r"ZZ?", "S", "S"),
)

#: Letters of a key: of metaphone as the search asks for it, of double metaphone as it is defined.
METAPHONE_LENGTH, DOUBLE_LENGTH = 6, 4

# ---- end of fixed values ----


@lru_cache(maxsize=32)
def _machine(rules: tuple, flags: frozenset) -> tuple[re.Pattern, tuple]:
    """One pattern of all rules that hold for words with these flags, and what each of its named groups writes."""
    live = [r for r in rules if len(r) < 4 or (r[3].removeprefix("-") in flags) != r[3].startswith("-")]
    parts = []
    for i, r in enumerate(live):
        parts.append(f"(?P<r{i}>{r[0].replace(chr(92) + '1', f'(?P=s{i})').replace('(?<=([A-Z]))', f'(?<=(?P<s{i}>[A-Z]))')})")
    return re.compile("|".join(parts)), tuple(live)


def rewritten(word: str, rules: tuple, which: int) -> str:
    """The key (1: first, 2: second) that the rules write for an upper-case word of letters; = writes the matched letter."""
    pattern, live = _machine(rules, frozenset(name for name, p in FLAGS.items() if re.search(p, word)))
    out, at = [], 0
    while at < len(word):
        m = pattern.match(word, at)
        rule = live[int(m.lastgroup[1:])]
        out.append(rule[which].replace("=", m.group()[:1]))
        at = m.end()
    return "".join(out)


def letters(word: str) -> str:
    return re.sub("[^A-Z]", "", word.upper())


def metaphone(word: str, length: int = METAPHONE_LENGTH) -> str:
    return rewritten(letters(word), METAPHONE, 1)[:length]


def double_metaphone(word: str, length: int = DOUBLE_LENGTH) -> tuple[str, str]:
    """(first, second) key; equal where the word has one reading."""
    own = letters(word)
    return rewritten(own, DOUBLE_METAPHONE, 1)[:length], rewritten(own, DOUBLE_METAPHONE, 2)[:length]


@F.pandas_udf(StructType([StructField(k, StringType()) for k in ("metaphone", "first", "second")]))
def _keys(words: pd.Series) -> pd.DataFrame:
    known = {w: (metaphone(w), *double_metaphone(w)) for w in words.dropna().unique()}
    return pd.DataFrame([known.get(w, (None, None, None)) for w in words], columns=["metaphone", "first", "second"], dtype=object)


def sound_keys(word: Column) -> Column:
    """struct(metaphone, first, second) of a word's ASCII letters, others left out; '' where there is none, nulls for null. For distinct words: it runs in Python."""
    return _keys(word)
