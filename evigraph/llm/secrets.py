"""Secret scan: fixed patterns, and novelty under a dictionary-primed compressor.

A candidate is a long unbroken run of key-like characters with a word before or after it that names something
sensitive, whatever letters and digits it has; only runs of nothing but words of the dictionary are passed over. It
is measured by its marginal compressed size: bytes of zstandard output for its surroundings with it,
less those without it, where the compressor is primed with a dictionary of code, identifier words and
common phrases. Words, paths and repeated text compress away; random keys don't. A candidate that costs
at least MIN_BYTES_PER_CHAR bytes a character is reported as a span of kind `novel`. A long key of few different characters costs less than that, however
random it is (digits: 3.3 bits): letters and digits of LONG characters and more need ENTROPY_SHARE of the entropy of the alphabet that they show, where that is less.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import bound_batches

#: The base patterns, in their order of listing.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost maximal runs: the same as [0-9a-f]+ with 24 or more characters
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex")

#: What a candidate looks like, and the words that make its surroundings sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|credential|auth|bearer|private|signature|session|cookie|login", re.IGNORECASE)
CONTEXT_BEFORE, CONTEXT_AFTER = 64, 32
MIN_BYTES_PER_CHAR = 0.75
#: Of a run of nothing but letters and digits; random ones cost 1.12 times their entropy and more at any length, by what the compressor adds.
LONG, ENTROPY_SHARE = 32, 1.05

#: The dictionary that the compressor is primed with.
DICTIONARY = """
import from class def return self None True False async await lambda yield raise except finally try with as
public private protected static final void int long double float boolean string String char byte new this super
function const let var export default require module exports undefined null typeof instanceof prototype
if else elif for while do switch case break continue goto struct union enum typedef extern sizeof namespace template
SELECT FROM WHERE GROUP BY ORDER INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE ALTER DROP JOIN LEFT RIGHT INNER
http:// https:// www. .com .org .net index.html /usr/local/bin /etc/ /home/user/ /var/log/ C:\\Program Files\\
get set add remove update delete create find list item items value values name names index count size length total
user users username account admin client server request response header body content type application json xml html
config configuration settings options params arguments environment variable default enabled disabled timeout retry
password passwd secret token api_key apikey access_key private_key credential authorization bearer session cookie
example placeholder changeme your-key-here YOUR_API_KEY xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef ---------------- ================ ________________
2019-01-01T00:00:00 2020-12-31 application/x-www-form-urlencoded text/html charset=utf-8 Content-Type Content-Length
""".encode()

_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_WORDS = {w.lower() for w in re.findall(r"[A-Za-z]{3,}", DICTIONARY.decode())}


def only_words(found: str) -> bool:
    """Whether a run has nothing but words of the dictionary and separators."""
    return all(w.lower() in _WORDS for w in _PART.findall(found))


def alphabet(found: str) -> int:
    """How many characters the alphabet has that a run of letters and digits seems to be drawn from: digits, and letters (of hex digits, or all) of each case."""
    size = 10 * any(c.isdigit() for c in found)
    for first, last in (("a", "z"), ("A", "Z")):
        own = [c for c in found if first <= c <= last]
        size += 0 if not own else 6 if max(own).lower() <= "f" and size else 26
    return max(size, 2)


def least_bytes(found: str, per_char: float) -> float:
    """What a candidate must cost to be reported."""
    if len(found) >= LONG and found.isalnum():
        per_char = min(per_char, ENTROPY_SHARE * math.log2(alphabet(found)) / 8)
    return per_char * len(found)


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def marginal(self, before: str, found: str, after: str) -> int:
        a, b, c = (x.encode("utf-8", "replace") for x in (before, found, after))
        return len(self._compress(a + c + b)) - len(self._compress(a + c))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in the order of the digest."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, per_char: float = MIN_BYTES_PER_CHAR) -> list[tuple[int, int]]:
    """Incompressible candidates in a sensitive context that no base span overlaps. base is in order, as base_spans gives it."""
    out, at, covered = [], 0, 0
    for m in CANDIDATE.finditer(text):
        found = m[0]
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            covered, at = max(covered, base[at][2]), at + 1
        if covered > start:
            continue
        before, after = text[max(0, start - CONTEXT_BEFORE) : start], text[end : end + CONTEXT_AFTER]
        if not (SENSITIVE.search(before) or SENSITIVE.search(after)) or only_words(found):
            continue
        if novelty.marginal(before, found, after) >= least_bytes(found, per_char):
            out.append((start, end))
    return out


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string"


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", per_char: float = MIN_BYTES_PER_CHAR) -> DataFrame:
    """A row for every row of docs: the id, counts of each kind, base_spans and all spans.

    Spans are kind:start:end in code points, end exclusive, joined by commas, by start and then kind in
    the order assign, access, hex, novel. A null text counts as empty: zero counts, empty strings. Repeated rows give
    repeated results; an empty table gives none; other columns are not read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    kind_id = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                novel = novel_spans(text, base, novelty, per_char)
                every = sorted(base + [(s, 3, e) for s, e in novel])
                named = [(s, (*KINDS, "novel")[k], e) for s, k, e in every]
                counts = [sum(k == i for _, k, _ in every) for i in range(4)]
                rows.append((*counts, _join([x for x in named if x[1] != "novel"]), _join(named)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"`{id_col}` {kind_id}, {SCHEMA}")


def base_digest(base_spans_col: str = "base_spans"):
    """Lowercase hex SHA-256 of the base spans."""
    return F.sha2(F.col(base_spans_col).cast("binary"), 256)


def digest_of(text: str) -> str:
    """The same, of one text, for tests and callers outside Spark."""
    return hashlib.sha256(_join([(s, KINDS[k], e) for s, k, e in base_spans(text)]).encode()).hexdigest()
