"""Operator 7: personal data, also where it is disguised, with spans in the source text.

Base identifiers are found in the text as it stands. Two transducers then
rewrite it: one maps look-alike, full-width, mathematical and other digits and
letters to ASCII and drops invisible characters; one maps "(at)", "[dot]",
"name at host dot org", "name_at_host_dot_org", "name @ host . org", runs of spelled digits and
numbers with spelled or bracketed dots to what they stand for; mail and numbers share its dots. A transducer gives its edits;
from them, each identifier found in the rewritten text maps back to source
characters. Such a span is added where its source differs from it and no base
span of its kind holds it; it may reach beyond a base span, which stays.

An "at" with no other sign of disguise, as in "look at example.com", counts
where the host is in lower case after its first dot and ends in letters, and the
word before it is no word of prose. A word with a digit or sign in it is none. Of
others the corpus tells: of the words that stand so before a host anywhere,
those that at least one in ``PROSE_SHARE`` documents (and PROSE_DOCS) has in
lower case elsewhere are prose. Without a corpus (``find_pii`` of one text) every plain
word counts as prose.

Every step reads the text once or twice, so that very long texts take time in
proportion to their length.

Defined cases: a null or empty text has no spans; offsets are code points, end
exclusive; repeated rows are searched each; an empty table gives no rows; other
columns stay as they are, and one that has the name of the result is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("disguised", "boolean"))

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match never starts inside a run of digits, as the one before takes whole runs
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

# fixed values: letters that look like ASCII ones
LOOKALIKES = dict(zip("аеорсухіјѕԁɡһӏкАВЕКМНОРСТУХІЈЅαοινρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdghlkABEKMHOPCTYXIJSaoivpABEZHIKMNOPTYX", strict=True))
DASHES = "‐‑‒–—―−﹘﹣"
DOTS = "。．｡․"
INVISIBLE = "­​‌‍⁠﻿"
MATHEMATICAL = "\U0001d400-\U0001d7ff"
GLYPH = re.compile(f"[{''.join(LOOKALIKES)}{DASHES}{DOTS}{INVISIBLE}\u00a0٠-٩۰-۹०-९！-～{MATHEMATICAL}]")
# fixed values: names of digits
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
#: A word before a bare "at" is prose if one in so many documents, and so many at least, have it elsewhere.
PROSE_SHARE, PROSE_DOCS = 2_000, 2
#: A bare "at" between a plain word and a host, in the expressions of the engine.
BARE_AT = r"(?<![A-Za-z0-9._%+\-])([A-Za-z]+)\s{1,3}(?:[Aa][Tt]|@)\s{1,3}[A-Za-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,}"
#: Local parts where they stand before any kind of "at", which tell nothing of prose.
LOCALS = BARE_AT + r"|[A-Za-z0-9._%+\-]+(?:\s{0,2}[\[({<]\s?(?:[Aa][Tt]|@)\s?[\])}>]|\s{0,3}@|_at_|\s{1,3}[Aa][Tt]\s{1,3}[A-Za-z0-9\-]+(?:\s{1,3}[Dd][Oo][Tt]\s|\s?[\[({<]))"
LOCAL_BYTES = re.compile(LOCALS.encode())
#: What follows the word, which is quick to look for.
AFTER_AT = r"\s(?:[Aa][Tt]|@)\s{1,3}[A-Za-z0-9\-]+\.[a-z0-9\-]"
#: Letters stay, all other bytes part words.
LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Words before a bare "at" that every task holds at most.
FEW_WORDS = 20_000
#: Texts that a task masks at once.
MASKED = 256
ANY_DIGIT = "(?:" + "|".join(DIGITS) + ")"
AT = re.compile(r"(?i)\s{0,2}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,2}|(?<=[a-z0-9])_at_(?=[a-z0-9])|(?<=[a-z0-9])\s{1,3}(?:at|@)\s{1,3}(?=[a-z0-9])|@")
BRACKET_DOT = r"\s{0,2}[\[({<]\s?(?:dot|\.)\s?[\])}>]\s{0,2}"
DOT = re.compile("(?i)" + BRACKET_DOT + r"|(?<=[a-z0-9])\s\.\s(?=[a-z0-9])|(?<=[a-z0-9])_dot_(?=[a-z0-9])|(?<=[a-z0-9])\s{1,3}dot\s{1,3}(?=[a-z0-9])")
LABEL = re.compile(r"[A-Za-z0-9-]++")
RUN = re.compile(rf"(?i)(?<![a-z0-9])(?:plus[\s-]{{1,2}})?(?:{ANY_DIGIT}|[0-9]++)\b(?:(?:\s{{1,3}}(?:dot|point)\s{{1,3}}|{BRACKET_DOT}|[\s-]{{1,2}})(?:{ANY_DIGIT}|[0-9]++)\b)++")
PART = re.compile(rf"(?i)(?P<dot>\s{{1,3}}(?:dot|point)\s{{1,3}}|{BRACKET_DOT})|(?P<plus>plus)[\s-]{{1,2}}|(?P<digit>{ANY_DIGIT})|(?P<gap>[\s-]{{1,2}})")
SPELLED = re.compile(rf"(?i)\b(?:{ANY_DIGIT}|plus|dot|point)\b|(?<=[0-9])\s{{0,2}}[\[({{<]\s?\.")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of local part, @ and host with a dot; linear, from each @ outwards."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        low = host.end() if host else at + 1
        at = text.find("@", low)


def identifiers(text: str):
    """(kind, start, end) of the base identifiers, by kind, then start."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


class Tape:
    """A text rewritten by edits (start, end, replacement), in order and apart; each output character stands for a source range."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at = [], 0
        self.outs: list[int] = []  # where each edit's replacement begins in the output
        self.edits = edits
        n = 0
        for start, end, out in edits:
            parts += [text[at:start], out]
            n += start - at
            self.outs.append(n)
            n += len(out)
            at = end
        self.text = "".join([*parts, text[at:]])

    def source(self, i: int) -> tuple[int, int]:
        """The source range of the i-th output character."""
        k = bisect_right(self.outs, i) - 1
        if k < 0:
            return i, i + 1
        start, end, out = self.edits[k]
        if i < self.outs[k] + len(out):
            return start, end
        at = end + i - self.outs[k] - len(out)
        return at, at + 1


def glyph(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in DOTS:
        return "."
    if c == "\u00a0":
        return " "
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c >= "\U0001d400":
        plain = unicodedata.normalize("NFKC", c)
        return LOOKALIKES.get(plain, plain)
    return str(unicodedata.decimal(c))


def plain_glyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), glyph(m[0])) for m in GLYPH.finditer(text)]


def address(text: str, at: re.Match, dots_before: dict[int, tuple[int, int]], dots_after: dict[int, tuple[int, int]], low: int, prose: frozenset[str] | None) -> list[tuple[int, int, str]]:
    """Edits that make an address around one "at"; none if there is no disguised one. dots: spelled dots by where they end and start; low: no character before it is used."""
    def bare(x: str) -> bool:
        return x[:1].isspace() and x.strip()[:1].lower() in ("a", "@")

    start, edits, spelled = at.start(), [], False
    while True:  # chunks of the local part, from right to left
        chunk = start
        while chunk > low and text[chunk - 1] in LOCAL:
            if start - chunk and chunk in dots_before:
                break
            chunk -= 1
        if chunk == start:
            break
        start, dot = chunk, dots_before.get(chunk)
        if dot is None or dot[0] <= low:
            break
        edits.append((*dot, "."))
        spelled, start = True, dot[0]
    local = text[start:at.start()]
    if edits and start == edits[-1][0]:  # nothing stands before the last dot
        start = edits.pop()[1]
        local, spelled = text[start:at.start()], bool(edits)
    if not local:
        return []
    end, host_dots, last, n = at.end(), [], "", 0
    while m := LABEL.match(text, end):
        last, end, n = m[0], m.end(), n + 1
        dot = dots_after.get(end)
        following = dot and LABEL.match(text, dot[1])
        if following and following[0].lower() != "dot":
            host_dots.append((*dot, "."))
            end = dot[1]
        elif text[end:end + 1] == "." and LABEL.match(text, end + 1):
            end += 1
        else:
            break
    if n < 2:
        return []
    if at[0] == "@" and not host_dots and not spelled:
        return []  # a base address
    if bare(at[0]) and not host_dots and not spelled:
        tail = text[at.end():end].partition(".")[2]
        if tail != tail.lower() or not (last.isalpha() and len(last) > 1):
            return []
        if local.isalpha() and (prose is None or local.lower() in prose):
            return []
    return edits[::-1] + [(at.start(), at.end(), "@")] + host_dots


def plain_words(text: str, prose: frozenset[str] | None = None) -> list[tuple[int, int, str]]:
    """Edits for spelled signs and digits; prose: words that are no local part before a bare "at" (None: all plain words)."""
    edits: list[tuple[int, int, str]] = []
    if re.search(r"(?i)at\b|at_|@", text):
        dots = [m.span() for m in DOT.finditer(text)]
        before, after, low = {e: (s, e) for s, e in dots}, {s: (s, e) for s, e in dots}, 0
        for at in AT.finditer(text):
            if at.start() < low:
                continue
            found = address(text, at, before, after, low, prose)
            if found:
                edits += found
                low = max(at.end(), found[-1][1])
    taken = [s for s, _, _ in edits]
    if SPELLED.search(text):
        for m in RUN.finditer(text):
            i = bisect_right(taken, m.end())
            if not SPELLED.search(m[0]) or (i and edits[i - 1][1] > m.start()):
                continue
            for p in PART.finditer(text, m.start(), m.end()):
                edits.append((*p.span(), "." if p["dot"] else "+" if p["plus"] else DIGITS[p["digit"].lower()] if p["digit"] else ""))
    return sorted(edits)


def find_pii(text: str | None, prose: frozenset[str] | None = None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) by kind as in KINDS, then start; prose as in ``plain_words``."""
    if not text:
        return []
    base = [(*x, False) for x in identifiers(text)]
    tapes, plain = [], text
    for transducer in (plain_glyphs, lambda t: plain_words(t, prose)):
        if edits := transducer(plain):
            tapes.append(Tape(plain, edits))
            plain = tapes[-1].text
    if not tapes or plain == text:
        return base
    starts = {k: [x[1] for x in base if x[0] == k] for k in KINDS}
    ends = {k: [x[2] for x in base if x[0] == k] for k in KINDS}
    added = []
    for kind, start, end in identifiers(plain):
        s, e = start, end
        for tape in tapes[::-1]:
            s, e = tape.source(s)[0], tape.source(e - 1)[1]
        i = bisect_right(starts[kind], s) - 1
        if text[s:e] != plain[start:end] and not (i >= 0 and e <= ends[kind][i]):
            added.append((kind, s, e, True))
    return sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _held(words: frozenset[str]):
    """A task's (word, documents): in how many of its documents each of ``words`` stands in lower case and before no kind of "at"."""
    def run(batches):
        wanted, counts = {w.encode() for w in words}, Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                t = text.as_py() or b""
                if not wanted.isdisjoint(t.translate(LETTERS).split()):  # few texts are read again, without their addresses
                    counts.update(wanted.intersection(LOCAL_BYTES.sub(b" ", t).translate(LETTERS).split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def prose_words(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """The words that stand before a bare "at" and a host somewhere in ``docs`` and are prose elsewhere.

    A word counts once a document, in lower case and outside such places. As
    at least one document in PROSE_SHARE has each, there are at most PROSE_SHARE times
    as many as a document has different words, so that they fit the driver and
    every task whatever the corpus. The words that stand so before a host are
    counted in tasks that hold all of them, up to FEW_WORDS; beyond, by a join.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    near = texts.where(F.col("text").rlike(AFTER_AT)).select(F.explode(F.regexp_extract_all("text", F.lit(BARE_AT), F.lit(1))).alias("word"))
    found = near.select(F.lower("word").alias("word")).distinct()
    few = [r["word"] for r in found.limit(FEW_WORDS + 1).collect()]
    if not few:
        return frozenset()
    if len(few) <= FEW_WORDS:
        counted = texts.mapInArrow(_held(frozenset(few)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    else:
        words = F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", LOCALS, " "), F.lit("(?<![A-Za-z])([a-z]+)(?![A-Za-z])"), F.lit(1)))
        counted = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(found, "word", "left_semi")
    least = max(PROSE_DOCS, -(-docs.count() // PROSE_SHARE))
    return frozenset(r["word"] for r in counted.where(F.col("n") >= least).select("word").collect())


def pii_spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """``docs`` with the array column ``into`` of the text's spans; a column of that name is replaced."""
    prose = prose_words(docs, text)

    @F.pandas_udf(SPANS)
    def spans_of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(("kind", "start", "end", "disguised"), x)) for x in find_pii(t, prose)])

    return docs.withColumn(into, spans_of(F.col(text)))


def masked(text: str | None, prose: frozenset[str] | None = None) -> str | None:
    """A text with its spans replaced by their kinds."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e, _ in sorted(find_pii(text, prose), key=lambda x: (x[1], -x[2])):
        if s < at:  # overlaps the one before: one mask covers both
            at = max(at, e)
            continue
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a null text stays null."""
    prose = prose_words(docs, text)

    @F.arrow_udf(T.StringType())
    def mask(text: pa.Array) -> pa.Array:
        # a few rows at a time, so that a batch's texts are not all Python objects at once
        parts = [pa.array([masked(t, prose) for t in text.slice(at, MASKED).to_pylist()], text.type) for at in range(0, len(text), MASKED)]
        return pa.concat_arrays(parts) if parts else text

    return docs.withColumn(text, mask(F.col(text)))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, base counts by kind, base_sha256, spans and n_disguised of each row."""
    found = pii_spans(docs.select(F.col(key).alias(key), "text")).drop("text")
    base = F.filter("pii_spans", lambda x: ~x["disguised"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(key, *map(count, KINDS), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii_spans")).alias("spans"), F.size(F.filter("pii_spans", lambda x: x["disguised"])).cast("bigint").alias("n_disguised"))
