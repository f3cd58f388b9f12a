"""Secret scans: fixed patterns, and zstandard novelty against code and identifier dictionaries.

Three patterns give the base spans. The method adds candidates in a sensitive context (a word
such as key or token shortly before or after, or inside): the context goes on over strings with
no letter or digit between them, as the lines of a key or the parts of a token. What is assigned
to such a name is a candidate with its punctuation too. A string's marginal cost is what it adds to the
compressed size of its surroundings, under a dictionary of code and identifiers. A string that
costs nearly its own information content is new to both its surroundings and the dictionary,
and is reported as kind ``novel``.

Edge cases: a null text has no spans; offsets count code points; a document of any length is
scanned whole; a candidate that overlaps a base span isn't reported again; spans that start
together go by kind; repeated rows are scanned each; an empty table gives no rows; other columns than
doc_id and text are not read (``carry`` hands them on). Identifiers that neither the surroundings nor
the dictionary hold cost as much as random letters, so a candidate needs a digit and letters (with
punctuation inside also capitals or punctuation); strings of letters alone are not reported as novel.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.llm.common import carried, map_rows, row_schema

# The three patterns of the contract, in the order of their kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as [0-9a-f]+ of 32 characters or more

CONTEXT = re.compile(r"password|passwd|passphrase|pwd|secret|token|key|auth|credential|private|bearer|access|signature",
                     re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ASSIGNED = re.compile(r"=+(?=[A-Za-z0-9+/])")  # between a name and its value, not a value's padding
# What is assigned to a name with a sensitive word in it, quoted or up to white space.
VALUE = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|key|auth|credential)s?["']?\x20{0,8}[:=]\x20{0,8}"""
                   r"""(?P<quote>["'])?(?P<value>(?(quote)[^\s"']{12,256}|[^\s"'<>{}()\[\],;]{12,256}))""", re.ASCII | re.IGNORECASE)
GAP = re.compile(r"[\W_]{0,32}")
LAST_LINE = re.compile(r"\s+([A-Za-z0-9+/=]{1,15})(?=\s+-----END)")
CONTEXT_CHARS, AROUND_CHARS = 64, 512
# Bytes of marginal cost per character above which a string is new: random letters and digits
# cost about 0.75 bytes, words and identifiers of the surroundings well under a half.
NOVELTY = 0.55

# Code and identifiers that surround secrets in ordinary files.
PRIMER = " ".join("""
import os sys json re logging requests boto3 hashlib base64 datetime subprocess pathlib typing
def class return self init None True False lambda yield async await raise except finally with
config settings environment variable environ getenv setdefault configuration parameters options
public private protected static final void string integer boolean double float object interface
function const let var export default module require prototype undefined constructor callback
password passwd secret token api_key apikey access_key secret_key client_id client_secret auth
authorization bearer credential credentials signature private_key public_key certificate session
username hostname database connection endpoint region bucket account service request response
http https localhost example com org net www index html application content type accept charset
select from where insert into values update delete create table primary foreign key references
SHA256 AES128 RSA2048 HMAC BEGIN END PRIVATE KEY CERTIFICATE abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 00000000-0000-0000-0000-000000000000
""".split()).encode()


class Novelty:
    def __init__(self, primer: bytes = PRIMER):
        words = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False)

    def cost(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds to its compressed surroundings, per character."""
        before, after = text[max(0, start - AROUND_CHARS):start], text[end:end + AROUND_CHARS]
        around = (before + after).encode("utf-8", "replace")
        marginal = len(self.size.compress(around + text[start:end].encode())) - len(self.size.compress(around))
        return marginal / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def in_context(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, sensitive words inside) of each candidate near a sensitive word, and of their neighbours."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return []
    pieces = []
    for m in CANDIDATE.finditer(text):
        at, known = m.start(), len(pieces)
        for cut in [*ASSIGNED.finditer(text, m.start(), m.end()), None]:
            end = cut.start() if cut else m.end()
            if CANDIDATE.fullmatch(text, at, end):
                pieces.append((at, end))
            at = cut.end() if cut else end
        if len(pieces) == known:  # only short parts
            pieces.append(m.span())
    near, inside = [], []
    first = 0
    for start, end in pieces:
        while first < len(words) and words[first][1] <= start:
            first += 1
        after = first
        while after < len(words) and words[after][0] < end:
            after += 1
        inside.append(words[first:after])
        near.append(after > first or (first > 0 and start < words[first - 1][1] + CONTEXT_CHARS)
                    or (after < len(words) and end > words[after][0] - CONTEXT_CHARS))
    joins = [GAP.fullmatch(text, a, b) is not None for (_, a), (b, _) in zip(pieces, pieces[1:])]
    for i, join in enumerate(joins):
        near[i + 1] |= near[i] and join
    for i in range(len(joins) - 1, -1, -1):
        near[i] |= near[i + 1] and joins[i]
    return [(*piece, own) for piece, own, n in zip(pieces, inside, near) if n]


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings near a sensitive word, outside base spans."""
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # the end of the spans up to each one

    def free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)  # spans from there on start behind it
        return not at or reach[at - 1] <= start

    def novel(start: int, end: int, kinds: int = 2) -> bool:
        value = text[start:end]
        mixed = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value),
                     not value.isalnum() and kinds > 2))
        return (mixed >= kinds and any(c.isdigit() for c in value) and free(start, end)
                and novelty.cost(text, start, end) >= NOVELTY)

    found = []
    for m in VALUE.finditer(text):  # a value that punctuation makes more than a candidate
        if not CANDIDATE.fullmatch(text, *m.span("value")) and novel(*m.span("value"), kinds=3):
            found.append((m.start("value"), 3, m.end("value")))
    taken = [(a, b) for a, _, b in found]
    value_starts, value_ends = [a for a, _ in taken], [b for _, b in taken]
    for start, end, words in in_context(text):
        # whole, or what stands beside the sensitive words in it
        tries = [(start, end)]
        if words:
            tries += [(words[0][1], end), (words[-1][1], end), (start, words[0][0])]
        for a, b in tries:
            at = bisect_left(value_starts, b)
            if at and value_ends[at - 1] > a:  # inside a reported value
                continue
            if CANDIDATE.fullmatch(text, a, b) and novel(a, b):
                found.append((a, 3, b))
                last = LAST_LINE.match(text, b)
                if last and free(last.start(1), last.end(1)):
                    found.append((last.start(1), 3, last.end(1)))
                break
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, primer: bytes = PRIMER, carry: bool = False) -> DataFrame:
    """doc_id, spans (array of kind, start, end by start), base (string), spans_text, masked (string).

    With ``carry`` also row, the whole input row as a struct.
    """
    def make():
        novelty = Novelty(primer)

        def step(part):
            out = {"doc_id": part["doc_id"], "spans": [], "base": [], "spans_text": [], "masked": []}
            for text in part["text"]:
                base = base_spans(text or "")
                every = sorted(base + novel_spans(text or "", base, novelty)) if text else []
                out["spans"].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
                out["base"].append(joined(base))
                out["spans_text"].append(joined(every))
                out["masked"].append(mask(text, every))
            return out | ({"row": part["row"]} if carry else {})
        return step

    schema = ("doc_id long, spans array<struct<kind:string,start:long,end:long>>, base string, "
              "spans_text string, masked string" + row_schema(docs, carry))
    return map_rows(docs.select("doc_id", "text", *carried(docs, carry)), None, schema, make=make)


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind's mark."""
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def span_digests(found: DataFrame) -> DataFrame:
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2("base", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))
