"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Base kinds (email, ip, card, phone) are always kept once their check passes; context only
raises their score. The other kinds need a score of at least `min_score`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutymark.llm.common import table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "local_phone", "national_id", "secret")
ENTITIES = "array<struct<kind:string,start:int,end:int,score:double>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Characters of an IBAN by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
_LOCAL_PHONE = re.compile(r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:token|secret|password|api_key)\s?[=:]\s?\"[A-Za-z0-9+/_-]{16,}\"")

#: Score before context, and the words near a span that add CONTEXT to it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.4, "national_id": 0.4, "secret": 0.8}
CONTEXT = 0.2
WORDS = {
    "email": ("mail", "email", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "mastercard", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "national_id": ("ssn", "social", "security", "id"),
    "secret": ("key", "secret", "token", "aws"),
}
_NEAR = {kind: re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE) for kind, words in WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern in time linear in the text: from each @ to the left and to the right."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod-97: a whole run of upper-case words, else its beginning of the country's length if a word ends there.

    After a run that fails the search goes on behind its first character; runs are bounded, so the time stays linear.
    """
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        if not mod97(m[0].replace(" ", "")):
            places = [k for k in range(start, end) if text[k] != " "][: IBAN_SIZES.get(m[0][:2], 0)]
            end = places[-1] + 1 if places and len(places) == IBAN_SIZES[m[0][:2]] else start
            if end == start or text[end : end + 1].isalnum() or not mod97(text[start:end].replace(" ", "")):
                end = start
        if end > start:
            yield start, end
        m = _IBAN.search(text, max(end, start + 1))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose own check passes: part ranges, digit counts, Luhn, mod-97."""
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    for m in _SECRET.finditer(text):
        yield "secret", m.start(), m.end()
    if not re.search("[0-9]", text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in ibans(text):
        yield "iban", s, e
    for kind, pattern in (("local_phone", _LOCAL_PHONE), ("national_id", _NATIONAL)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def entities(text: str, min_score: float = 0.5, reach: int = 40) -> list[dict]:
    """All spans of a text, by kind as listed, then start. An extra span inside a base span is dropped."""
    found = []
    for kind, start, end in proposals(text):
        near = text[max(0, start - reach) : start] + " " + text[end : end + reach]
        score = min(1.0, SCORE[kind] + CONTEXT * bool(_NEAR[kind].search(near)))
        if kind in BASE or score >= min_score:
            found.append((kind, start, end, score))
    base = [f for f in found if f[0] in BASE]
    found = base + [f for f in found if f[0] not in BASE and not any(f[1] < b[2] and b[1] < f[2] for b in base)]
    order = {k: i for i, k in enumerate(BASE + EXTRA)}
    found.sort(key=lambda f: (order[f[0]], f[1]))
    return [{"kind": k, "start": s, "end": e, "score": round(x, 3)} for k, s, e, x in found]


def redacted(text: str, found: list[dict]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first start wins and covers the rest."""
    out, at = [], 0
    for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= at:
            out += [text[at : f["start"]], f"[{f['kind'].upper()}]"]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per input row: id, entities (code point spans, end exclusive). Null text: no entities.

    Map only: no shuffle. Repeated rows each get a row; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([entities(t or "", min_score) for t in b.column(1).to_pylist()], kind)], ["id", "entities"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(scan, f"id {df.schema['id'].dataType.simpleString()}, entities {ENTITIES}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """docs with personal data in text_col replaced by [KIND]; n_chars, if there, follows. Null text stays null.

    Only the text travels to Python and back with its row; all other columns and their order stay.
    """
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and redacted(t, entities(t, min_score)) for t in b.column(b.schema.names.index(text_col)).to_pylist()]
            arrays = [pa.array(texts, pa.string()) if n == text_col else b.column(i) for i, n in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    out = docs.mapInArrow(scan, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    joined = lambda e: F.array_join(F.transform(e, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("entities", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("entities", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("entities").alias("spans"))
