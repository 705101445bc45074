"""Operators on single rows against brute force: rules, personal data, token counts, verdicts."""

import hashlib
import random
import re
import time

import pytest

from tallyhouse.llm import pii
from tallyhouse.llm.pii import KINDS, find_pii, luhn, mask_pii, pii_digest, pii_spans, plain_glyphs, plain_words, prose_words, Tape
from tallyhouse.llm.quality_classifier import quality_verdicts
from tallyhouse.llm.quality_rules import RULES, cascade_order, quality_rules
from tallyhouse.llm.token_counts import Automaton, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b c d e f g h i j", "a b c d e a b c d e x", "x " * 40, "l1\nl2\nl1\n \nl1", "zé ü\x1fq\x85r　s", "# * $ % & | < >", "w" * 50_000]


def test_quality_rules(spark):
    random.seed(3)
    texts = ODD + ["".join(random.choice(["a ", "b ", "c\n", "dd ", "!! ", "# ", "A "]) for _ in range(random.randint(0, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int").repartition(3)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert sorted(cascade_order(df)) == sorted(RULES)
    reverse = {r.doc_id: r for r in quality_rules(df, order=sorted(RULES)).collect()}
    assert got == reverse and len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        repeat = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat)), t[:50]
        assert r.base_failed == (len(words) < 10 or 100 * len(repeat) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules(df.limit(0)).collect() == []


def brute_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_base_pii():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    random.seed(4)
    for _ in range(20_000):
        t = "".join(random.choice("a1.@-+ 0(") for _ in range(random.randint(0, 40)))
        assert [x[:3] for x in find_pii(t) if not x[3]] == brute_pii(t), t


@pytest.mark.parametrize("text, kind, source", [
    ("mail john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("john dot smith at example dot co dot uk bye", "email", "john dot smith at example dot co dot uk"),
    ("x jоhn＠exаmple.com", "email", "jоhn＠exаmple.com"),
    ("plus one four one five five five five zero one zero zero", "phone", "plus one four one five five five five zero one zero zero"),
    ("é ＋１ ４１５ ５５５ ２１８６.", "phone", "＋１ ４１５ ５５５ ２１８６"),
    ("at one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
    ("4111 1111 1111 ١١١١", "card", "4111 1111 1111 ١١١١"),
])
def test_disguised_pii(text, kind, source):
    assert [(k, text[s:e], d) for k, s, e, d in find_pii(text)] == [(kind, source, True)]


@pytest.mark.parametrize("text, kind, source", [
    ("jοhn@gmail.com", "email", "jοhn@gmail.com"), ("mail 𝐣ohn@gmail.com", "email", "𝐣ohn@gmail.com"), ("so john at example.com,", "email", "john at example.com"),
    ("john  at  gmail  dot  com", "email", "john  at  gmail  dot  com"), ("x john_at_gmail_dot_com", "email", "john_at_gmail_dot_com"), ("on 10 dot 0 dot 0 dot 1 now", "ip", "10 dot 0 dot 0 dot 1"),
    ("ip 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"), ("ip 192(dot)168(dot)0(dot)1", "ip", "192(dot)168(dot)0(dot)1"), ("to john @ example . com", "email", "john @ example . com"), ("ask jane at example.museum", "email", "jane at example.museum"), ("jo.fox @ example.com", "email", "jo.fox @ example.com"),
    ("john dot smith at example.com", "email", "john dot smith at example.com"), ("to ann@gmail dot com", "email", "ann@gmail dot com"), ("a\u200bb@c.de", "email", "a\u200bb@c.de"),
])
def test_longer_spans_and_more_disguises(text, kind, source):
    found = find_pii(text, frozenset())
    assert (kind, text.index(source), text.index(source) + len(source), True) in found
    assert [x[:3] for x in found if not x[3]] == brute_pii(text)


def test_random_disguises():
    """Every address planted in prose is found with its very span, and nothing else is."""
    random.seed(11)
    names, hosts = ["ann", "jo.fox", "x_1", "b+c", "kim7"], [["mail", "com"], ["ab-c", "co", "uk"], ["x", "org"], ["host9", "de"]]
    homoglyph = {"a": "а", "o": "ο", "c": "с", "e": "е", "x": "х", "m": "𝐦"}
    prose = ["we", "met", "house", "river,", "nine", "dotted", "attic", "see.", "(all)"]
    for _ in range(3000):
        at, dot = random.choice([(" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), ("_at_", "_dot_"), ("  at  ", " dot "), ("@", " dot "), (" @ ", None), ("@", ".")])
        if dot is None:
            at, dot = "{at}", "."
        plain = (name := random.choice(names)) + "@" + ".".join(host := random.choice(hosts))
        disguised = name.replace(".", dot if dot != "_dot_" else ".") + at + dot.join(host)
        if random.random() < 0.3:
            disguised = "".join(homoglyph.get(c, c) if random.random() < 0.3 and at == "@" and dot == "." else c for c in disguised)
        before, after = " ".join(random.choices(prose, k=3)) + " ", " " + " ".join(random.choices(prose, k=3))
        text = before + disguised + after
        spans = {(s, e) for k, s, e, _ in find_pii(text) if k == "email"}
        assert (len(before), len(before) + len(disguised)) in spans, text
        assert all(len(before) <= s and e <= len(before) + len(disguised) for s, e in spans), text
        assert slow_address(text[len(before):len(before) + len(disguised)]) == plain, text
        tapes, rewritten = [], text
        for transducer in (plain_glyphs, plain_words):
            tapes.append(Tape(rewritten, transducer(rewritten)))
            rewritten = tapes[-1].text
        assert plain in rewritten, (text, rewritten)  # what the span maps back from is the very address


def slow_address(source):
    """The address that a disguise stands for, by plain replacing."""
    plain = "".join({"а": "a", "ο": "o", "с": "c", "е": "e", "х": "x", "𝐦": "m"}.get(c, c) for c in source)
    return re.sub(r"\s*[\[({]dot[\])}]\s*|_dot_|\s+dot\s+", ".", re.sub(r"\s*[\[({]at[\])}]\s*|_at_|\s+at\s+", "@", plain))


def test_bare_at_by_the_corpus(spark, monkeypatch):
    """Words that the corpus has in prose are no local parts; recall and false alarms by disguise."""
    random.seed(8)
    prose = ["look", "shop", "studies", "nice", "hotel", "works", "house", "we", "met", "noon"]
    names = ["jane", "bob", "aiko", "tomas", "li"]
    planted, alarms = {k: [0, 0] for k in ("{} at {}.{}", "{} @ {}.{}", "{} at {} dot {}", "{}[at]{}[.]{}", "{} (at) {} . {}", "{}@{} . {}")}, 0
    rows, want = [], {}
    for i in range(600):
        text = " ".join(random.choices(prose, k=12)) + " "
        if i % 3 == 0:
            shape = random.choice(list(planted))
            address = shape.format(random.choice(names), random.choice(["mail", "x-1", "ab"]), random.choice(["com", "museum", "de"]))
            want[i] = (shape, len(text), len(text) + len(address))
            text += address + " " + random.choice(prose)
        elif i % 3 == 1:
            text += f"{random.choice(prose)} at {random.choice(['mit', 'shop', 'x'])}.{random.choice(['edu', 'de', 'com', 'Then'])} we"
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = prose_words(df)
    monkeypatch.setattr(pii, "FEW_WORDS", 1)  # the way of many words finds the same
    assert prose_words(df) == known
    monkeypatch.undo()
    assert {"look", "shop", "studies"} <= known and not known & set(names)
    for r in pii_spans(df).collect():
        spans = {(x["start"], x["end"]) for x in r.pii_spans if x["kind"] == "email"}
        if r.doc_id in want:
            shape, s, e = want[r.doc_id]
            planted[shape][0] += 1
            planted[shape][1] += (s, e) in spans
        else:
            alarms += bool(spans)
    print({k: f"{found} of {n}" for k, (n, found) in planted.items()}, "false alarms:", alarms)
    assert alarms == 0 and all(found == n for n, found in planted.values())
    masked_rows = {r.doc_id: r.text for r in mask_pii(df).collect()}
    assert all("<EMAIL>" in masked_rows[i] for i in want)
    assert prose_words(df.limit(0)) == frozenset() == prose_words(spark.createDataFrame([(1, None)], "doc_id long, text string"))


def test_long_texts_take_linear_time():
    for word in ("a dot ", "a at ", "one ", "1 dot ", "a@b dot ", "a_dot_", "а", "john at b dot "):
        began = time.process_time()
        find_pii(word * 100_000)
        assert time.process_time() - began < 20, word


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pii_spans int")
    assert pii_digest(df).collect() == [] and mask_pii(df).collect() == []


def test_plain_prose_has_no_pii():
    for t in ("We met at noon by the dot on the map.", "one two three go", "The price (at least) rose.", "look at that dot dot dot", "look at example.com", "available at shop.de", "met at noon.Then", "plus one", "", None):
        assert find_pii(t) == []


def test_pii_frame(spark):
    rows = [(1, "mail a.b@c.de or +1 (988) 555-2485", 5), (2, None, 5), (None, "", 5), (1, "ip 1.2.3.4", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii_digest(df).collect()
    want = "email:5:13,phone:17:34"
    first = next(r for r in got if r.n_email)
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone, first.spans, first.base_sha256) == (1, 0, 0, 1, want, hashlib.sha256(want.encode()).hexdigest())
    assert sum(r.spans == "" for r in got) == 2 and len(got) == 4
    assert sorted(str(r.text) for r in mask_pii(df).collect()) == ["", "None", "ip <IP>", "mail <EMAIL> or <PHONE>"]
    assert KINDS == ("email", "ip", "card", "phone")


def test_entropy_and_links(spark):
    from tallyhouse.llm.quality_rules import RULES, cascade_order, cascade_work, entropy, quality_rules

    assert entropy("") == 0 and entropy("aaaa") == 0 and entropy("abcd" * 5) == 2.0
    good = "The river went by the old stone house and nine of us walked on to the green hill."
    rows = [(1, "ab ba " * 20 + " ".join(map(str, range(3)))), (2, " ".join(f"www.{w}.com" for w in good.split())), (3, good), (4, None), (5, ""), (3, good)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    assert sorted((r.doc_id, r.kept) for r in quality_rules(df).collect()) == [(1, False), (2, False), (3, True), (3, True), (4, False), (5, False)]
    order = cascade_order(df)
    assert sorted(order) == sorted(RULES)
    work = cascade_work(df, order=order).orderBy("position").collect()
    assert [r.rule for r in work] == order and work[0].evaluated == len(rows) and sum(r.rejected for r in work) == 4
    assert all(b.evaluated == a.evaluated - a.rejected for a, b in zip(work, work[1:]))
    assert cascade_work(df.limit(0)).collect() == []


def greedy(word, first, inside):
    n, at, pieces = 0, 0, first
    while at < len(word):
        size = max((len(p) for p in pieces if p and word.startswith(p, at)), default=0)
        if not size:
            return 0
        n, at, pieces = n + 1, at + size, inside
    return n


def test_automaton():
    random.seed(5)
    for _ in range(300):
        def some(alphabet):
            return [bytes(random.choices(alphabet, k=random.randint(1, 5))) for _ in range(random.randint(1, 12))]
        first, inside = some(b"abc"), some(b"abc")
        automaton = Automaton(first, inside)
        for _ in range(60):
            w = bytes(random.choices(b"abc", k=random.randint(1, 12)))
            assert automaton.count(w) == greedy(w, first, inside), (first, inside, w)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "ab abc zz", 0), (1, None, 0), (None, "", 0)], "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words, r.n_pieces, r.n_unknown) for r in token_counts(df, Automaton([b"ab"], [b"c"])).collect()}
    assert got == {(1, 3, 4, 1), (1, 0, 0, 0), (None, 0, 0, 0)}
    assert token_counts(df.limit(0), Automaton([b"ab"], [b"c"])).collect() == []


def test_verdicts(spark):
    random.seed(6)
    good = ["the", "cat", "sat", "on", "a", "mat", "and", "saw", "dogs", "run"]
    rows = [(i, "en", " ".join(random.choices(good, k=60))) for i in range(300)]
    rows += [(1000 + i, "en", " ".join("".join(random.choices("qxzjk", k=6)) for _ in range(60))) for i in range(20)] + [(5000, None, None), (None, "en", "the cat"), (3, "en", "the cat sat")]
    labels = [(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_verdicts(docs, table).collect()
    assert len(got) == len(rows)
    assert not any(r.kept for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1020)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 300) >= 290
    assert quality_verdicts(docs.limit(0), table.limit(0)).collect() == []
    assert all(r.kept for r in quality_verdicts(docs, table.limit(0)).collect())
