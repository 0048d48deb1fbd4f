"""Secret scans: fixed patterns, and strings in sensitive contexts that a primed compressor cannot shorten.

Base spans are the leftmost non-overlapping matches of three patterns (assign,
access, hex) whose length suffices. The method adds spans of kind ``novel``: within
``REACH`` characters after a sensitive word, every run of ``LEAST`` or more characters of
tokens is a candidate if its characters could be those of a key: two of lower-case, upper-case and digits, or
``LEAST_PLAIN`` or more upper-case letters or digits alone. Runs joined by dots are one candidate if
one of them is long enough; what a base span covers is left out of it. A zstandard
compressor is primed with a dictionary of common identifiers, with those parts of the candidate
(split at punctuation, digits and case) that are words of the corpus, and with the text around the
candidate (its own repeats taken out); the candidate's marginal compressed bytes, by its
length, are its novelty. They are taken in blocks of at most ``BLOCK`` bytes, because from
64 bytes on the compressor also gains from a small alphabet, which keys have. Ordinary
identifiers and copied code compress; keys do not. A candidate is reported if it, or a
long enough run of it, has a novelty of ``NOVELTY`` or more.

The words of the corpus are parts of ``PART`` letters or more near sensitive words, counted over all rows; the
``WORDS`` most frequent of those in ``WORD_DOCS`` documents or more are known.

Defined cases: null and empty texts have no spans; all positions are code points and
ends are exclusive; long texts are scanned whole; repeated rows give repeated results;
an empty table gives an empty result; other columns are not read (``redact`` keeps
them).
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, the least length of what they must hold, in the order of their kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "novel"]
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

CONTEXT = re.compile(
    r"(?i:pass(?:word|wd|phrase)|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer)", re.ASCII
)
CONTEXT_WORDS = [b"passw", b"passp", b"secret", b"token", b"api", b"key", b"credential", b"authorization", b"bearer"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Runs joined by dots, 16 characters at least.
DOTTED = re.compile(r"(?=[A-Za-z0-9+/_=.-]{16})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST, LEAST_PLAIN, REACH, AROUND, NOVELTY, BLOCK = 16, 20, 40, 1024, 0.8, 63
#: A word of an identifier: letters of one case, or a capital and small letters.
PARTS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}(?![a-z])")
PART, WORD_DOCS, WORDS = 4, 3, 50_000

#: Words that make up ordinary identifiers, placeholders and file names.
IDENTIFIERS = (
    "password passwd secret token apikey api_key access_key private_key client_secret client_id credential authorization bearer "
    "username user_name session cookie config settings environment variable default example placeholder changeme your_ xxxx "
    "function return import class public private static const string number boolean object array value name type path file "
    "https http www example com org net localhost server host port database connection request response header content "
    "application json text html utf-8 base64 encode decode encrypt decrypt hash sha256 md5 digest signature certificate "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 "
).encode()

SPAN = "struct<kind:string,start:int,end:int,value_start:int,value_end:int>"


def parts_of(text: str) -> list[str]:
    """The words that identifiers in a text are made of."""
    return [p for p in PARTS.findall(text) if len(p) >= PART]


def novelty(candidate: str, around: str, known: frozenset = frozenset(), dictionary: bytes = IDENTIFIERS) -> float:
    """Marginal compressed bytes of a candidate per byte, given its surroundings, the known words in it and the dictionary."""
    own = candidate.encode()
    words = " ".join(p for p in parts_of(candidate) if p.lower() in known)
    outside = dictionary + around.encode().replace(own, b" ") + words.encode() + b" "
    step = -(-len(own) // -(-len(own) // BLOCK))
    cost = 0
    for at in range(0, len(own), step):
        primed = zstandard.ZstdCompressionDict(outside + own[max(0, at - AROUND) : at], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        cost += len(press.compress(own[at : at + step])) - len(press.compress(b""))
    return cost / len(own)


def base_spans(text: str, lowered: bytes) -> list[tuple[str, int, int, int, int]]:
    """``lowered``: the text's bytes with A-Z lowered, to skip patterns that cannot match."""
    out = []
    if any(w in lowered for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # a run of fewer characters holds no longer one, so the least length can be part of the pattern
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, lowered: bytes, taken: list[tuple[str, int, int, int, int]], known: frozenset = frozenset()) -> list[tuple[str, int, int, int, int]]:
    if not any(w in lowered for w in CONTEXT_WORDS):
        return []
    covered = _merged(taken)
    out, done = [], 0
    for context in CONTEXT.finditer(text):
        # a match may be cut off at the end of the reach, so it is made again from its start
        for near in DOTTED.finditer(text, max(done, context.end()), context.end() + REACH + LEAST):
            if near.start() < done:
                continue
            end = DOTTED.match(text, near.start()).end()
            done = max(done, end)
            for a, b in _free(near.start(), end, covered):
                out += [("novel", m.start(), m.end(), m.start(), m.end()) for m in DOTTED.finditer(text, a, b) if _is_novel(text, m.start(), m.end(), known)]
    return out


def _merged(spans: list[tuple[str, int, int, int, int]]) -> list[tuple[int, int]]:
    """The ranges that spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for _, a, b, _, _ in sorted(spans, key=lambda x: x[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a range outside of ordered, separate ranges."""
    out = []
    at = bisect.bisect_right(covered, start, key=lambda x: x[1])
    while at < len(covered) and covered[at][0] < end:
        out.append((start, covered[at][0]))
        start = covered[at][1]
        at += 1
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def _could_be_key(s: str) -> bool:
    kinds = [bool(re.search(k, s)) for k in ("[a-z]", "[A-Z]", "[0-9]")]
    return sum(kinds) > 1 or (len(s) >= LEAST_PLAIN and not kinds[0])


def _is_novel(text: str, start: int, end: int, known: frozenset) -> bool:
    runs = [(m.start(), m.end()) for m in CANDIDATE.finditer(text, start, end)]
    for a, b in dict.fromkeys([(start, end), *runs] if runs else []):
        s = text[a:b]
        if _could_be_key(s):
            around = text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]
            if novelty(s, around, known) >= NOVELTY:
                return True
    return False


def corpus_words(docs: DataFrame) -> frozenset:
    """Lower-case words near sensitive words, of at least ``WORD_DOCS`` documents; the most frequent ``WORDS`` of them."""

    def count(batches):
        for b in batches:
            total: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                lowered = (t or "").encode().lower()
                if not any(w in lowered for w in CONTEXT_WORDS):
                    continue
                near = _merged([("", max(0, m.start() - AROUND), m.end() + AROUND, 0, 0) for m in CONTEXT.finditer(t)])
                for word in {p.lower() for a, e in near for p in parts_of(t[a:e]) if len(p) <= 40}:
                    total[word] = total.get(word, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= WORD_DOCS)
    return frozenset(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(WORDS).collect())


def spans_of(text: str | None, known: frozenset = frozenset()) -> list[tuple[str, int, int, int, int]]:
    """All spans by start, then kind."""
    if not text:
        return []
    lowered = text.encode().lower()
    base = base_spans(text, lowered)
    return sorted(base + novel_spans(text, lowered, base, known), key=lambda x: (x[1], KINDS.index(x[0])))


def _spans(batches, known):
    kind = pa.list_(pa.struct([("kind", pa.string()), *[(k, pa.int32()) for k in ("start", "end", "value_start", "value_end")]]))
    for b in batches:
        found = [[dict(zip(("kind", "start", "end", "value_start", "value_end"), s)) for s in spans_of(t.as_py(), known)] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, value_start, value_end: what must not be shown)."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))
    return docs.mapInArrow(lambda batches: _spans(batches, shared.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: str, spans: list[tuple[str, int, int, int, int]], mark: str = "[secret]") -> str:
    """The text with every value, and every run of overlapping values, replaced by the mark."""
    out, done = [], 0
    for start, end in sorted((s[3], s[4]) for s in spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All documents and columns, secrets replaced in ``text`` and ``n_chars`` counted anew where it changed."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            texts, changed = [], {}
            for i, t in enumerate(b.column(text_at)):
                t = t.as_py()
                spans = spans_of(t, shared.value)
                if spans:
                    t = redacted(t, spans, mark)
                    changed[i] = len(t)
                texts.append(t)
            columns = list(b.columns)
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            if chars_at is not None and changed:
                counts = columns[chars_at].to_pylist()
                for i, n in changed.items():
                    counts[i] = n
                columns[chars_at] = pa.array(counts, b.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    # columns go through under plain names, since the names of a table may be anything
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
