r"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums.

One Aho-Corasick pass over a text (A-Z lower-cased) finds every keyword. Only where a keyword hit begins is
its kind's expression tried, anchored, in the order of the hits; a hit inside the previous match of its kind is
passed over, so the matches are the leftmost non-overlapping ones. Long hexadecimal runs have no keyword;
their prefilter is a table over the bytes of the text.

Kinds, in their order for spans of one start:

* ``assign``: keyword, optional quote, ``:`` or ``=``, value of 6 or more characters
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters in all
* ``hex``: a run of 24 or more of 0-9, a-f
* ``forge``: ``ghp_``, ``gho_``, ``ghu_``, ``ghs_``, ``ghr_`` or ``npm_`` and 36 base-62 characters, of which the
  last 6 are the CRC-32 of the 30 before, in base 62; other text of this form is no secret
* ``jwt``: three base-64 parts of which the first decodes to a JSON object with ``alg``
* ``pem``: the header line of a private key

Spans are code points, end exclusive. Null text is empty and has no span; rows are independent, so repeated
rows give equal results. Extra columns are kept apart and never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netsift.llm import registry

# The keywords and forms of secrets.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
FORGE_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
KINDS = ["assign", "access", "hex", "forge", "jwt", "pem"]
BASE_KINDS = ["assign", "access", "hex"]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
FORGE = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[0-9A-Za-z_-]+)\.([0-9A-Za-z_-]+)\.([0-9A-Za-z_-]+)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[str, int, int]


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits))


def _has_alg(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


#: kind -> (expression, test of a match); a failing match still uses up its text.
FORMS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "forge": (FORGE, lambda m: checksum62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _has_alg(m[1])),
    "pem": (PEM, lambda m: True),
}


def automaton() -> ahocorasick.Automaton:
    """Keyword -> (kind, length); keywords are in lower case."""
    found = ahocorasick.Automaton()
    for kind, words in (
        ("assign", ASSIGN_WORDS), ("access", ["akia"]), ("forge", FORGE_WORDS), ("jwt", ["eyj"]),
        ("pem", ["-----begin "]),
    ):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[0x30:0x3A] = _HEX_BYTE[0x61:0x67] = True


def _may_have_hex(raw: bytes) -> bool:
    """Whether there can be a run of 24: one whole aligned word of 12 bytes lies in any such run."""
    n = len(raw) // 12 * 12
    return n > 0 and bool(_HEX_BYTE[np.frombuffer(raw, np.uint8, n)].reshape(-1, 12).all(axis=1).any())


def scan(text: str, keywords: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower().decode("utf-8", "surrogatepass")  # bytes.lower touches A-Z only, so positions stay
    hits: dict[str, list[int]] = {}
    for end, (kind, length) in keywords.iter(low):
        hits.setdefault(kind, []).append(end - length + 1)
    spans: list[Span] = []
    for kind, starts in hits.items():
        form, good = FORMS[kind]
        free = 0
        for start in sorted(starts):
            if start >= free and (m := form.match(text, start)):
                free = m.end()
                if good(m):
                    spans.append((kind, m.start(), m.end()))
    if _may_have_hex(raw):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, and ``spans``, an array of (kind, start, end)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    target = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(text or "", keywords)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, target)], ["id", "spans"])

    out = rows.mapInArrow(work, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(out["id"].alias(id_col), "spans")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every span of every text replaced by a mask; overlapping spans are masked as one.

    Null texts stay null. All other columns pass unchanged, whatever their names.
    """
    place = docs.columns.index(text_col)

    def cleaned(text: str | None, keywords: ahocorasick.Automaton) -> str | None:
        spans = scan(text, keywords) if text else []
        if not spans:
            return text
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [text[at:start], mask]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            texts = [cleaned(t, keywords) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, from the spans of ``find_secrets``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
            base = [joined([s for s in row if s[0] in BASE_KINDS]) for row in found]
            counts = {k: [sum(s[0] == k for s in row) for row in found] for k in BASE_KINDS}
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in BASE_KINDS},
                "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([joined(row) for row in found], pa.string()),
            })

    spans = find_secrets(docs)
    kind = spans.schema["doc_id"].dataType.simpleString()
    return spans.mapInArrow(
        work, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


@registry.query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document. Not for SQL: leftmost matches with later dropping need a loop over matches."""
    return secret_digests(registry.table(spark, sf_dir, "documents"))
