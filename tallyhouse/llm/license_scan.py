"""Operator 3: licence families of paragraphs, with DataFrame and SQL functions only.

A multinomial logistic regression over sparse word n-grams (one and two words,
ridge penalty) is trained on the paragraphs of whole licence texts and on notices
made by rule: whole, as spans that a line break leaves, with words left out,
and with foreign words around them. Its class "unknown" learns from a bounded
sample of the corpus' own paragraphs (those that share little with any
template), from prose with the words of licences, and from templates with their
words in shuffled order; lines that hold a licence's bare name without sharing more
with any template (German prose has "mit") teach it too, some for each name. A part of the templates, not of their variants, is
left out of training: on it, a temperature is chosen that makes the
probabilities most likely, and the least probability of a family that keeps its
false alarms at or below ``FALSE_ALARMS`` of the unknown. A predicted family is
confirmed when a paragraph and one of its templates share enough of their word
pairs, measured against the smaller of the two, and no other family's template
shares more. Without a shared pair, or where only another family's template
shares enough, the family is unknown.

Paragraphs are runs of lines between blank lines, of any width and number, and
each line by itself; in runs of more than ``SPAN`` lines also the short lines
(up to ``SHORT_LINE`` characters) among ``SPAN`` neighbouring ones, so that a
wrapped licence within a longer run is seen by itself. The model decides
on all of them: a paragraph is set aside before its n-grams are added up only
where the most that each of its n-grams can speak for any family against
"unknown" does not add up to outweigh it. Returned is a paragraph of which the model holds some licence likelier
than none, and that shares a word pair with a template; its family is "unknown" where no single one is likely enough. A
wrapped paragraph is returned where none of its lines is confirmed for its
family by itself and no overlapping one before it has that family; unconfirmed
lines within it are left out.

Defined cases: a null or empty text has no paragraphs; repeated rows are each
scanned; equal probabilities give the first family by name; an empty table
gives no rows (its unknown class then learns from the fixed sentences alone);
other columns are ignored; a very long line is one paragraph.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .license_texts import NAMES, NOTICES, OTHER, PARAGRAPHS, SHORT
from .shared import written

UNKNOWN = "unknown"
#: Variants of a paragraph and of a notice; one template in HELD_OUT calibrates.
VARIANTS, NOTICE_VARIANTS, HELD_OUT, FALSE_ALARMS, CONFIRM = 12, 2, 6, 0.01, 0.5
#: Paragraphs without words that teach the unknown class.
EMPTY = 500
#: Paragraphs of the corpus at most, from as many documents, that teach the unknown class; the characters of each at most.
CORPUS_SAMPLE, SAMPLE_CHARS = 2_000, 2_000
#: Documents, and lines for each bare name of a licence, that teach the unknown class at most.
NAME_DOCS, NAME_LINES = 5_000, 150
#: Least probability of a family, whatever the false alarms of the held-out part.
LEAST_PROBABILITY = 0.4
LEAST_SPREAD = 0.3
SHORT_LINE, SPAN, STEP = 100, 6, 3
#: Word pairs that a paragraph or template shares at least with a template to be compared by the smaller one.
LEAST_PAIRS = 2
WORD = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
FILLER = "thus house green river often speaks nine window late other stone carry".split()


def tokens(text: Column) -> Column:
    """Words of letters, digits and inner dots, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def template_words(text: str) -> list[str]:
    """The words of a constant text, as ``tokens`` has them."""
    return re.findall(WORD, text.lower())


def ngrams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def templates() -> list[tuple[str, str, str, bool]]:
    """(family, text, kind, held) of all templates; held: left out of training, for calibration."""
    out = [(k, t, "paragraph", i % HELD_OUT == HELD_OUT - 1) for k, ts in sorted(PARAGRAPHS.items()) for i, t in enumerate(ts)]
    for k, (names, ids) in sorted(NAMES.items()):
        out += [(k, p.format(n), "notice", (i + j) % HELD_OUT == 0) for i, n in enumerate(names) for j, p in enumerate(NOTICES)]
        out += [(k, p.format(n), "notice", (i + j) % HELD_OUT == 0) for i, n in enumerate(ids) for j, p in enumerate(SHORT)]
    return out + [(UNKNOWN, t, "notice", i % HELD_OUT == 0) for i, t in enumerate(OTHER)]


def template_pairs() -> list[tuple[str, int, str]]:
    """(family, number of its pairs, pair) for each template that has pairs; templates with the same pairs once."""
    seen = {}
    for k, t, _, _ in templates():
        w = template_words(t)
        if k != UNKNOWN and len(w) > 1:
            seen[(k, tuple(sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))] = None
    return [(k, i, len(ps), p) for i, (k, ps) in enumerate(seen) for p in ps]


def one_of(grams: list[str], name: str = "g") -> str:
    """SQL that tells whether a gram is one of a constant list, by a hash table."""
    return f"{name} in ({', '.join(repr(g) for g in grams)})" if grams else "false"


def examples(spark: SparkSession) -> DataFrame:
    """(family, words, held) of the training sentences: the templates' variants."""
    base = spark.createDataFrame(templates(), "family string, text string, kind string, held boolean").coalesce(1).withColumn("words", tokens(F.col("text")))
    filler = F.array(*map(F.lit, FILLER))
    wide = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "paragraph", VARIANTS - 1).otherwise(NOTICE_VARIANTS - 1))))

    def random(*what) -> Column:  # a fixed number in 0..99 for each thing
        return F.pmod(F.xxhash64("text", "variant", *what), F.lit(100)).cast("int")

    def noise(side: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(filler, (F.pmod(F.xxhash64("text", "variant", F.lit(side), i), F.lit(len(FILLER))) + 1).cast("int")))

    size = F.size("words")
    # spans of a paragraph, as line breaks leave them: 8 words at least
    length = F.least(size, F.greatest(F.lit(8), F.floor(size * (random(F.lit(3)) + 1) / 100).cast("int")))
    span = F.slice("words", F.floor((size - length) * random(F.lit(4)) / 99).cast("int") + 1, length)
    is_span = (F.col("kind") == "paragraph") & (F.col("variant") % 2 == 1)
    chosen = wide.withColumn("words", F.when(is_span, span).otherwise(F.col("words")))
    thinned = F.filter("words", lambda w, i: (F.col("kind") == "notice") | (F.col("variant") % 4 < 2) | (random(i) >= 10))
    around = F.when(F.col("variant") % 3 == 1, F.concat(noise(1, 4), thinned)).when(F.col("variant") % 3 == 2, F.concat(thinned, noise(2, 6))).otherwise(thinned)
    shuffled = F.transform(F.array_sort(F.transform("words", lambda w, i: F.struct(F.xxhash64("variant", w, i).alias("at"), w.alias("w")))), lambda x: x["w"])
    salad = wide.where(f"family != '{UNKNOWN}' and variant = 0 and size(words) > 12").select(F.lit(UNKNOWN).alias("family"), shuffled.alias("words"), "held")
    # the foreign words alone speak for no family
    empty = spark.range(0, EMPTY, 1, 1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"), (F.col("id") % HELD_OUT == 0).alias("held"))
    plain = wide.where("variant % 3 = 1").select(F.lit(UNKNOWN).alias("family"), F.concat(noise(1, 4), noise(2, 6)).alias("words"), "held")
    return chosen.select("family", around.alias("words"), "held").unionByName(salad).unionByName(plain).unionByName(empty)


def bare_names() -> list[str]:
    """The words of licences' identifiers that can stand for one by themselves."""
    return sorted({w for _, ids in NAMES.values() for i in ids for w in template_words(i) if len(w) > 2 and w.isalpha()})


def corpus_sample(docs: DataFrame, most: int = CORPUS_SAMPLE) -> DataFrame:
    """words of lines of the corpus that share under a fifth of the pairs of every template.

    At most ``most`` lines, one of a document, and at most NAME_LINES for each bare
    name, of at most about NAME_DOCS documents; all chosen by hash, so that reruns agree.
    """
    n, at = docs.count(), F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    some = docs.select("text").where(at < int(min(1.0, max(NAME_DOCS, most) / max(1, n)) * (1 << 30)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    line = F.get(lines, F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    one = some.where(at < int(min(1.0, 0.9 * most / max(1, n)) * (1 << 30))).select(F.substring(line, 1, SAMPLE_CHARS).alias("line")).where("line is not null")
    names = bare_names()
    named = some.select(F.explode(F.filter(lines, lambda x: x.rlike(f"(?i)(?<![A-Za-z0-9])({'|'.join(names)})(?![A-Za-z0-9])"))).alias("line")).select(F.substring("line", 1, SAMPLE_CHARS).alias("line")).distinct()
    named = named.select("line", F.explode(F.array_intersect(tokens(F.col("line")), F.array(*map(F.lit, names)))).alias("name"))
    named = named.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy(F.xxhash64("line"), "line"))).where(F.col("n") <= NAME_LINES)
    words = one.unionByName(named.select("line").distinct()).select(tokens(F.col("line")).alias("words"))
    rows = words.where(F.size("words") > 0).withColumn("uid", F.monotonically_increasing_id())
    pairs = docs.sparkSession.createDataFrame(template_pairs(), "family string, template int, size int, pair string")
    rows = written(rows, "licence-corpus")
    near = rows.select("uid", F.explode(F.array_distinct(ngrams(F.col("words")))).alias("pair")).join(F.broadcast(pairs), "pair").groupBy("uid", "template", "size").count()
    near = near.where("5 * count >= size and (count >= 2 or size <= 3)").select("uid").distinct()
    return rows.join(near, "uid", "left_anti").select("words")


def fit(spark: SparkSession, data: DataFrame) -> dict:
    """Families by class, intercepts, and weights of each n-gram of a table (family, grams)."""
    families = sorted([*PARAGRAPHS, UNKNOWN])
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    counted = CountVectorizer(inputCol="grams", outputCol="features", minDF=3.0, vocabSize=20_000, binary=True).fit(data)
    model = LogisticRegression(regParam=3e-4, maxIter=25, family="multinomial").fit(counted.transform(data.withColumn("label", label)).select("label", "features"))
    weights = model.coefficientMatrix.toArray()
    # n-grams that tell the families from each other by next to nothing are left out of the model
    spread = weights.max(axis=0) - weights.min(axis=0)
    rows = [(g, [float(x) for x in weights[:, i]]) for i, g in enumerate(counted.vocabulary) if spread[i] >= LEAST_SPREAD]
    return {"families": families, "intercepts": [float(x) for x in model.interceptVector], "rows": rows, "weights": spark.createDataFrame(rows, "gram string, weights array<double>").coalesce(1), "temperature": 1.0, "least": 0.5}


def train(docs: DataFrame) -> dict:
    """The model: families by class, intercepts, weights (rows, and a table gram, weights), temperature, least probability, and the recall of held-out templates."""
    spark = docs.sparkSession
    grams = F.array_distinct(ngrams(F.col("words"))).alias("grams")
    own = corpus_sample(docs).select(F.lit(UNKNOWN).alias("family"), grams, (F.pmod(F.xxhash64("words"), F.lit(HELD_OUT)) == 0).alias("held"))
    data = written(examples(spark).select("family", grams, "held").unionByName(own).coalesce(1), "licence-examples")
    out = fit(spark, data.where("not held"))
    label = F.array_position(F.array(*map(F.lit, out["families"])), F.col("family")).cast("int")
    held = written(logits(data.where("held").withColumn("uid", F.monotonically_increasing_id()), ["uid", "family"], out).withColumn("label", label), "licence-held")
    grid = with_softmax(held.withColumn("t", F.explode(F.array(*map(F.lit, [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0])))), F.col("t"))
    loss = grid.select("t", F.log(F.element_at("p", F.col("label"))).alias("p")).groupBy("t").agg(F.avg("p").alias("p")).orderBy(F.desc("p"), "t").first()
    out["temperature"] = loss["t"]
    judged = written(with_softmax(held, F.lit(out["temperature"])).select("family", known(F.col("p"), out).alias("best")), "licence-judged")
    alarms = judged.where(F.col("family") == UNKNOWN).agg(F.percentile("best.p", 1 - FALSE_ALARMS)).first()[0]
    out["least"] = max(LEAST_PROBABILITY, alarms or 0.0)
    out["recall"] = judged.where(F.col("family") != UNKNOWN).agg(F.avg(((F.col("best.family") == F.col("family")) & (F.col("best.p") > out["least"])).cast("double"))).first()[0]
    return out


def save_model(model: dict, spark: SparkSession, path: str) -> None:
    """The trained model as a small Parquet table."""
    rest = json.dumps({k: v for k, v in model.items() if k not in ("rows", "weights")})
    spark.createDataFrame([(rest, [r[0] for r in model["rows"]], [r[1] for r in model["rows"]])], "facts string, grams array<string>, weights array<array<double>>").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    """A model that ``save_model`` wrote; ``license_paragraphs`` takes it in place of training."""
    r = spark.read.parquet(path).first()
    rows = list(zip(r["grams"], r["weights"]))
    return json.loads(r["facts"]) | {"rows": rows, "weights": spark.createDataFrame(rows, "gram string, weights array<double>").coalesce(1)}


def logits(frame: DataFrame, keep: list[str], model: dict, likely: bool = False) -> DataFrame:
    """keep and the classes' logits, rounded to nine digits, of each row of ``frame`` (grams: distinct n-grams); keep identifies a row. likely: only rows with P(unknown) < 1/2."""
    n = len(model["families"])
    # at most vocabSize grams of the templates, so the side is safe to broadcast
    hits = frame.select(*keep, F.explode_outer("grams").alias("gram")).join(F.broadcast(model["weights"]), "gram", "left")
    sums = hits.groupBy(*keep).agg(*(F.coalesce(F.sum(F.element_at("weights", i + 1)), F.lit(0.0)).alias(f"w{i}") for i in range(n)))
    sums = sums.select(*keep, *(F.round(F.col(f"w{i}") + F.lit(model["intercepts"][i]), 9).alias(f"w{i}") for i in range(n)))
    if likely:
        u = model["families"].index(UNKNOWN)
        sums = sums.where(sum((F.exp((F.col(f"w{i}") - F.col(f"w{u}")) / F.lit(model["temperature"])) for i in range(n) if i != u), F.lit(0.0)) > 1)
    return sums.select(*keep, F.array(*(f"w{i}" for i in range(n))).alias("logits"))


def with_softmax(frame: DataFrame, temperature: Column) -> DataFrame:
    """``frame`` with p: the classes' probabilities from its column logits."""
    raised = frame.withColumn("top", F.array_max("logits")).withColumn("temperature", temperature)
    raised = raised.select("*", once(F.transform("logits", lambda v: F.exp((v - F.col("top")) / F.col("temperature")))).alias("raised"))
    raised = raised.select("*", once(F.aggregate("raised", F.lit(0.0), lambda a, b: a + b)).alias("all_raised"))
    return raised.select("*", once(F.transform("raised", lambda v: v / F.col("all_raised"))).alias("p")).drop("top", "raised", "all_raised")


def known(p: Column, model: dict) -> Column:
    """The likeliest family but for unknown, the first by name of equals: struct (p, family)."""
    named = [F.struct(F.element_at(p, i + 1).alias("p"), F.lit(-i).alias("order"), F.lit(f).alias("family")) for i, f in enumerate(model["families"]) if f != UNKNOWN]
    return F.array_max(F.array(*named))


def once(value: Column) -> Column:
    """``value`` as a generated column, which the optimizer does not compute again at each use."""
    return F.explode(F.array(value))


def gains(model: dict) -> tuple[list[tuple[float, list[str]]], float]:
    """N-grams by the most that they can speak for a family against "unknown" (less than nothing for most), in levels, and the sum that a returned paragraph has at least.

    A returned paragraph has P(unknown) < 1/2, so for some family f of n:
    z_f - z_unknown > -T ln(n). Its grams' gains make up for the intercepts,
    and no gram's gain is beyond the most of its level.
    """
    u = model["families"].index(UNKNOWN)
    rest = [i for i in range(len(model["families"])) if i != u]
    lack = min(model["intercepts"][u] - model["intercepts"][i] for i in rest) - model["temperature"] * math.log(len(rest)) - 1e-6
    most = {g: max(w[i] - w[u] for i in rest) for g, w in model["rows"]}
    levels: dict[float, list[str]] = {}
    for g, x in most.items():
        if x > 0:
            levels.setdefault(max(0.125, 2.0 ** (math.ceil(2 * math.log2(x)) / 2)), []).append(g)
        elif x < -0.125:
            levels.setdefault(-(2.0 ** (math.floor(2 * math.log2(-x)) / 2)), []).append(g)
    return sorted(levels.items()), lack


def runs(blank: Column) -> Column:
    """Structs (first, last) of the runs of two or more lines that are not blank."""
    ends = F.filter(F.sequence(F.lit(0), F.size(blank)), lambda i: F.coalesce(F.get(blank, i), F.lit(True)))
    starts = F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.size(ends) - 1))
    return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last"))), lambda r: r["last"] > r["first"])


def paragraphs(lines: Column, short: Column, run: Column) -> Column:
    """Structs (first, last, line): each line, each run, and of a run of more than SPAN lines the short ones among SPAN neighbours, from every STEP-th line on, where there are two or more."""
    each = F.transform(lines, lambda x, i: F.struct(i.alias("first"), i.alias("last"), x.alias("line")))
    whole = F.transform(run, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.array_join(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), " ").alias("line")))
    # places of the short lines of each span
    long_runs = F.filter(run, lambda r: r["last"] - r["first"] >= SPAN)
    spans = F.flatten(F.transform(long_runs, lambda r: F.transform(F.sequence(r["first"], r["last"], F.lit(STEP)), lambda s: F.filter(F.sequence(s, F.least(s + SPAN - 1, r["last"])), lambda i: F.get(short, i)))))
    # two spans of the same ends are one; the ends as one number, whose distinct values are found by hash
    ends = F.array_distinct(F.transform(F.filter(spans, lambda x: F.size(x) > 1), lambda x: F.get(x, 0).cast("long") * F.lit(1 << 31) + F.get(x, F.size(x) - 1)))
    first, last = lambda e: F.shiftright(e, 31).cast("int"), lambda e: e.bitwiseAND((1 << 31) - 1).cast("int")
    spans = F.transform(ends, lambda e: F.struct(first(e).alias("first"), last(e).alias("last"), F.array_join(F.transform(F.filter(F.sequence(first(e), last(e)), lambda i: F.get(short, i)), lambda i: F.get(lines, i)), " ").alias("line")))
    return F.concat(each, whole, F.when(F.exists(short, lambda x: x), spans).otherwise(F.array().cast("array<struct<first:int,last:int,line:string>>")))


def license_paragraphs(docs: DataFrame, model: dict | None = None, key: str = "doc_id") -> DataFrame:
    """key, paragraph (its first line, from 0), family, probability, similarity and confirmed of each paragraph that is likelier of a licence than not."""
    model = model or train(docs)
    spark = docs.sparkSession
    levels, lack = gains(model)
    texts = docs.select(F.col(key).alias(key), "text").where("text is not null").withColumn("row", F.monotonically_increasing_id()).select(key, "row", once(F.split("text", "\n")).alias("lines"))
    texts = texts.select("*", once(F.transform("lines", lambda x: (F.length(x) <= SHORT_LINE) & x.rlike("[A-Za-z0-9]"))).alias("short"))
    texts = texts.select("*", once(F.transform("lines", lambda x: ~x.rlike(r"[^\x09-\x0D ]"))).alias("blank")).select("*", once(runs(F.col("blank"))).alias("run"))
    units = texts.select(key, "row", F.inline(paragraphs(F.col("lines"), F.col("short"), F.col("run")))).select(key, "row", "first", "last", once(tokens(F.col("line"))).alias("words"))
    units = units.select(key, "row", "first", "last", "words", once(ngrams(F.col("words"))).alias("all"))
    # only a paragraph whose n-grams' gains could reach what is lacking can outweigh unknown
    units = units.select("*", once(F.expr(f"array_distinct(filter(all, g -> {one_of([g for _, x in levels for g in x])}))")).alias("weighed")).where(F.size("weighed") > 0)
    most = F.expr(f"aggregate(weighed, 0D, (a, g) -> a + case {' '.join(f'when {one_of(x)} then {v}D' for v, x in levels)} else 0D end)")
    units = units.where(most >= lack)
    pairs = template_pairs()
    units = units.select(
        key, "row", "first", "last", F.array_distinct("all").alias("grams"),
        F.expr(f"array_distinct(filter(all, g -> {one_of(sorted({p for *_, p in pairs}))}))").alias("pairs"), F.size(F.array_distinct(F.slice("all", F.size("words") + 1, F.size("words")))).alias("n_pairs"))
    unit = [key, "row", "first", "last", "n_pairs", "pairs"]
    found = with_softmax(logits(units, unit, model, likely=True), F.lit(model["temperature"])).select(*unit, once(known(F.col("p"), model)).alias("best"))
    found = found.select(*unit, F.when(F.col("best.p") > model["least"], F.col("best.family")).otherwise(UNKNOWN).alias("family"), F.round("best.p", 6).alias("probability"))
    # the templates' pairs: a fixed table
    table = spark.createDataFrame(pairs, "of string, template int, size int, pair string")
    own = [c for c in unit if c != "pairs"] + ["family", "probability"]
    shared = found.select(*own, F.explode_outer("pairs").alias("pair")).join(F.broadcast(table), "pair", "left")
    shared = shared.groupBy(*own, "template", "of").agg(F.count("template").alias("common"), F.first("size").alias("size"))
    smaller = F.greatest(F.least(F.col("size"), F.col("n_pairs")), F.lit(LEAST_PAIRS))
    alike, its = F.least(F.lit(1.0), F.col("common") / smaller), F.coalesce(F.col("of") == F.col("family"), F.lit(False))
    found = shared.groupBy(*own).agg(F.round(F.coalesce(F.max(F.when(its, alike)), F.lit(0.0)), 6).alias("similarity"), F.round(F.coalesce(F.max(F.when(~its, alike)), F.lit(0.0)), 6).alias("other"))
    lost = (F.col("similarity") == 0) | (F.col("similarity") < CONFIRM) & (F.col("other") >= CONFIRM)
    # what shares no word pair with any template is no licence, whatever the model holds
    found = found.where((F.col("similarity") > 0) | (F.col("other") > 0))
    found = found.withColumns({"family": F.when(lost, UNKNOWN).otherwise(F.col("family")), "similarity": F.when(lost, 0.0).otherwise(F.col("similarity"))})
    found = found.withColumn("confirmed", (F.col("similarity") >= CONFIRM) & (F.col("similarity") >= F.col("other")))
    one = F.struct("first", "last", "family", "probability", "similarity", "confirmed")
    of_text = found.groupBy(key, "row").agg(F.collect_list(one).alias("found"))

    def inside(line, span):
        return (line["first"] == line["last"]) & (line["first"] >= span["first"]) & (line["last"] <= span["last"])

    spans = F.filter("found", lambda b: (b["first"] < b["last"]) & b["confirmed"] & (b["family"] != UNKNOWN) & ~F.exists("found", lambda x: inside(x, b) & x["confirmed"] & (x["family"] == b["family"])))
    of_text = of_text.withColumn("spans", spans)
    heads = F.filter("spans", lambda b: ~F.exists("spans", lambda x: (x["family"] == b["family"]) & (x["first"] < b["first"]) & (x["last"] >= b["first"])))
    lines = F.filter("found", lambda x: (x["first"] == x["last"]) & (x["confirmed"] | ~F.exists("spans", lambda b: inside(x, b))))
    of_text = of_text.select(key, F.inline(F.concat(lines, heads)))
    return of_text.select(key, F.col("first").cast("bigint").alias("paragraph"), "family", "probability", "similarity", "confirmed")
