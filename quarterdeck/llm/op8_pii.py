"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans come from patterns for e-mail, IP, card and phone, each checked (parts, Luhn, digits). Then contexts are learned. Candidates are tokens
with six digits or an @. Those where a base span starts are the seeds, of weight 1; the others start at 0. Every candidate has patterns of six
forms on three sides:

left   `pair`, the two words before it; `word`, the word before it; `mark`, that word with the marks behind it (`token = "`)
right  `next`, the word after it
shape  `shape`, its letters and digits by class and length; `class`, the same without lengths: whether it has letters and digits, and is long

An earlier token with a digit or an @ counts as the word `#`, the start of the text as `^`, its end as `$`; neither long words nor white space
shorten a context. Patterns and candidates make a bipartite graph. In each round a pattern's score is the sum of its instances' weights over
its frequency in the whole corpus plus two, so a word that mostly stands before other things counts for nothing however large the corpus is; a
pattern of which candidates make up less than a fifth is dropped. With w the first weight and the best score on each side, an instance passes
1 - (1 - w)(1 - left)(1 - right)(1 - shape) to its patterns, but to those of a side without that side's own score: so seeds raise the general
shapes they have, these raise the words that stand before other tokens of such shapes, and none raises itself. After the rounds, occurrences with
1 - (1 - left)(1 - right)(1 - shape) of at least the score, half of which must come from left and right, become spans of kind `context`. No
pattern is given: what is found depends on the seeds and on the corpus alone.

Everything is DataFrame functions: positions come from the lengths of the parts between matches, graph rounds are aggregations over edges,
which are few, and patterns are joined with occurrences, never collected. A token or a pattern may be on most of the edges, so these joins are dealt in
`PARTS` parts each. Tables of the graph are written as few files, however many partitions a shuffle has. The text is read twice, once for spans and candidates, once to count the patterns' words; counting compares 64-bit hashes of
words, which enter scores only.

Patterns are written so that no text makes them backtrack: runs are possessive, and a match starts where a run does or the last match ended.

Defined results: a null text counts as empty and has no spans; repeated rows have the same spans; an empty table gives no rows; a column with a
result's name is replaced. Positions are code points, ends exclusive.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged
from .textstats import SPACE

KINDS = ["email", "ip", "card", "phone"]
PARTS = 16
EDGES = 250_000  # that many occurrences of patterns come to one file, if all cores have one
HELD = 1_000_000  # that many hashes of wanted patterns are broadcast; more are joined after counting
# The base patterns, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_TOKEN = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_MARKED = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++\s*+[^\p{L}\p{N}\s][^\p{L}\p{N}]*+"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def cut(text: Column, pattern: str) -> Column:
    """The matches with the parts before them: array of (gap, match)."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def spans(text: Column, kind: str) -> Column:
    """Spans of the matches that pass; only those are gathered, so many failing matches cost linear time."""
    needs = {"email": text.contains("@"), "ip": text.contains("."), "card": text.rlike("[0-9]"), "phone": text.contains("+")}[kind]
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["match"], F.lit("")))
        keep = x["match"].isNotNull() & valid(kind, x["match"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.when(needs, F.aggregate(cut(text, PATTERNS[kind]), zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPANS))


def words(gap: Column) -> Column:
    """The words of a part between tokens, in lower case and without marks."""
    return F.filter(F.split(F.lower(F.regexp_replace(gap, r"[^\p{L}\p{N}\s]+", "")), SPACE), lambda w: w != "")


def parts(text: Column) -> Column:
    """The tokens with a digit or an @, with the length of the part before each, its last two words, nearest first, its first word and its last marks."""
    cells = F.transform(cut(text, _TOKEN), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["match"].alias("match"), words(x["gap"]).alias("w"), ends(x["gap"], x["match"]).alias("marked")))
    return F.transform(cells, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), F.slice(F.reverse(x["w"]), 1, 2).alias("near"), F.get(x["w"], F.lit(0)).alias("first"),
                                                 x["marked"].alias("marked")))


def marks(text: Column) -> Column:
    """Every word with marks behind it, in lower case and without white space."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_MARKED), F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", ""))


def ends(gap: Column, token: Column) -> Column:
    """The last word of a part with the marks between it and the token's first letter or digit; null without marks."""
    lead = F.regexp_extract(token, r"\A[^\p{L}\p{N}]*+", 0)
    last = F.get(F.reverse(marks(F.concat(gap, lead))), F.lit(0))
    return F.when(F.concat(gap, lead).rlike(r"[^\p{L}\p{N}\s]\s*+\z"), last)


def shape(token: Column) -> Column:
    """Letters and digits of a token by class and length."""
    core = F.regexp_replace(token, r"[^A-Za-z0-9@.:-]+", "")
    runs = F.transform(F.regexp_extract_all(core, F.lit(r"[A-Za-z]++|[0-9]++|[@.:-]++"), F.lit(0)), lambda r: F.when(r.rlike(r"\A[0-9]"), F.concat(F.lit("9x"), F.length(r).cast("string")))
                       .when(r.rlike(r"\A[A-Za-z]"), F.concat(F.lit("ax"), F.length(r).cast("string"))).otherwise(r))
    return F.array_join(runs, "")


def general(token: Column) -> Column:
    """The most general shape: letters and digits or digits alone, of 16 characters or fewer."""
    core = F.length(F.regexp_replace(token, r"[^A-Za-z0-9@.:-]+", ""))
    return F.concat_ws(" ", F.when(token.rlike(r"\p{L}"), "a9").otherwise("9"), F.when(core >= 16, "long").otherwise("short"))


_OCCURRENCES = "array<struct<start:bigint,end:bigint,token:string,left:string,seed:boolean,word:string,mark:string,next:string>>"


def occurrences(cells: Column, starts: Column, base: Column) -> Column:
    """Candidate tokens with their surroundings: (start, end, token, left, seed, word, mark, next); `cells` is a column of parts(). A token where a
    base span starts is a seed; one that a base span covers otherwise is left out."""
    kind = _OCCURRENCES
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.lit("^"), F.lit("^")).alias("near"), F.array().cast(kind).alias("out"))

    def step(acc: Column, y: Column) -> Column:
        x, after = y["x"], y["after"]
        start = acc["at"] + x["gap"]
        end = start + F.length(F.coalesce(x["match"], F.lit("")))
        near = F.slice(F.concat(x["near"], acc["near"]), 1, 2)
        seed = F.exists(starts, lambda s: (s >= start) & (s < end))
        covered = F.exists(base, lambda s: (s["start"] < end) & (s["end"] > start))
        shaped = (F.length(F.regexp_replace(x["match"], "[^0-9]", "")) >= 6) | x["match"].contains("@")
        keep = x["match"].isNotNull() & (seed | (~covered & shaped))
        following = F.coalesce(after["first"], F.when(after["match"].isNotNull(), F.lit("#")).otherwise(F.lit("$")))
        row = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("token"), F.array_join(F.reverse(near), " ").alias("left"), seed.alias("seed"),
                       F.get(near, F.lit(0)).alias("word"), x["marked"].alias("mark"), following.alias("next"))
        return F.struct(end.alias("at"), F.slice(F.concat(F.array(F.lit("#")), near), 1, 2).alias("near"),
                        F.when(keep, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(cells, F.slice(cells, 2, F.size(cells)), lambda x, y: F.struct(x.alias("x"), y.alias("after")))
    return F.when(F.size(cells) > 1, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


SIDES = {"pair": "left", "word": "left", "mark": "left", "next": "right", "shape": "shape", "class": "shape"}


def keyed(found: DataFrame) -> DataFrame:
    """Occurrences with one row per pattern: form and key. A bare `#`, `^` or `$` is no pattern."""
    made = {"pair": F.col("left"), "word": F.col("word"), "mark": F.col("mark"), "next": F.col("next"), "shape": shape(F.col("token")), "class": general(F.col("token"))}
    forms = F.array(*[F.struct(F.lit(form).alias("form"), key.alias("key")) for form, key in made.items()])
    return found.withColumn("p", F.explode(forms)).select("*", "p.form", "p.key").drop("p").filter(F.col("key").isNotNull() & ~F.col("key").isin("#", "^", "$", "^ ^", "# #", "^ #"))


def hashed(form: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(form), *parts)


def counted(form: Column, key: Column) -> Column:
    """The hash under which a pattern's occurrences are counted; words before and after a token are counted alike."""
    pair = F.split(key, " ")
    return F.when(form == "pair", hashed("pair", F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))).when(form == "mark", hashed("mark", key)).otherwise(hashed("word", key))


def frequencies(texts: DataFrame, wanted: DataFrame, files: int | None = None) -> DataFrame:
    """(h, total): how often the wanted words, pairs and marks (column h) occur in the column __text, before or after anything. One pass. Counts of
    broadcast hashes come in `files` partitions at most, if given."""
    plain = F.lower(F.regexp_replace("__text", r"[^\p{L}\p{N}\s@]++", ""))
    tokens = F.split(F.regexp_replace(plain, r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "#"), SPACE)
    rows = texts.select(F.concat(F.array(F.lit("^"), F.lit("^")), F.filter(tokens, lambda w: w != "")).alias("w"), marks(F.col("__text")).alias("m"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: hashed("pair", a, b))
    rows = rows.select(F.explode(F.concat(F.transform("w", lambda w: hashed("word", w)), pairs, F.transform("m", lambda m: hashed("mark", m)))).alias("h"))
    some = wanted.select("h").distinct()
    if some.count() <= HELD:
        found = rows.join(F.broadcast(some), "h", "left_semi").groupBy("h").agg(F.count("*").alias("total"))
        return found.coalesce(files) if files else found
    return rows.groupBy("h").agg(F.count("*").alias("total")).join(some, "h", "left_semi")


def dealt(many: DataFrame, few: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """An inner join in which one key may hold most rows of `many`: they go to PARTS tasks by other columns, and each row of `few` to all of them."""
    part = F.pmod(F.xxhash64(*by), F.lit(PARTS))
    return many.withColumn("_part", part).join(few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), [*keys, "_part"]).drop("_part")


def side(form: Column) -> Column:
    return F.coalesce(*[F.when(form == f, F.lit(s)) for f, s in SIDES.items()])


def sides(best: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, left, right, shape): 1 - the best score on each side. `best`: rows (*keys, form, p)."""
    return best.groupBy(*keys).agg(*[(1 - F.coalesce(F.max(F.when(side(F.col("form")) == s, F.col("p"))), F.lit(0.0))).alias(s) for s in ("left", "right", "shape")])


def patterns(found: DataFrame, texts: DataFrame, files: int, rounds: int = 8, least: float = 0.2) -> DataFrame:
    """(form, key, p): the patterns' scores after the rounds. `found`: rows of keyed(). Both sides of the graph are aggregated before they meet; each table
    is at most `files` files."""
    edges = staged(found.groupBy("form", "key", "token").agg(F.count("*").alias("n"), F.max("seed").cast("double").alias("seed")), "op8-edges", files)
    known = edges.groupBy("token").agg(F.max("seed").alias("known"))
    met = edges.groupBy("form", "key").agg(F.sum("n").alias("seen"), F.count("*").alias("tokens")).filter("tokens > 1")
    wanted = staged(met.withColumn("h", counted(F.col("form"), F.col("key"))), "op8-wanted", files)
    shapes = F.col("form").isin("shape", "class")
    counts = staged(frequencies(texts, wanted.filter(~shapes), files), "op8-counts")
    totals = wanted.filter(~shapes).join(counts, "h").unionByName(wanted.filter(shapes).withColumn("total", F.col("seen")))
    held = staged(totals.filter(F.col("seen") >= least * F.col("total")).select("form", "key", F.greatest("seen", "total").alias("total")), "op8-held", files)
    links = staged(dealt(dealt(edges.drop("seed"), held, ["form", "key"], ["token"]), known, ["token"], ["form", "key"]), "op8-links", files)
    for done in (edges, wanted, counts):
        discard(done)
    rated, scored = links.withColumn("r", F.col("known")), None
    for k in range(rounds):
        scored = staged(rated.groupBy("form", "key").agg((F.sum(F.col("n") * F.col("r")) / (F.first("total") + 2)).alias("p")), "op8-patterns", files)
        if k + 1 < rounds:
            met = staged(sides(dealt(links, scored, ["form", "key"], ["token"]).select("token", "form", "p"), ["token"]), "op8-weights", files)
            others = [F.when(side(F.col("form")) == s, F.lit(1.0)).otherwise(F.col(s)) for s in ("left", "right", "shape")]
            rated = dealt(links, met, ["token"], ["form", "key"]).withColumn("r", 1 - (1 - F.col("known")) * others[0] * others[1] * others[2])
    return scored


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None, score: float = 0.8) -> DataFrame:
    """`carry` columns (all by default) with email, ip, card, phone and context: arrays of (start, end)."""
    carried = [c for c in (docs.columns if carry is None else carry) if c not in (*KINDS, "context")]
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    base = docs.select(*carried, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    base = base.withColumns({k: spans(F.col("__text"), k) for k in KINDS}).withColumn("__base", F.concat(*KINDS))
    base = base.withColumn("__starts", F.col("__base.start")).withColumn("__cells", F.when(F.col("__text").rlike("[0-9@]"), parts(F.col("__text"))))
    base = base.withColumn("__found", occurrences(F.col("__cells"), F.col("__starts"), F.col("__base")))
    rows = staged(base.drop("__text", "__base", "__starts", "__cells").withColumn("__row", F.monotonically_increasing_id()), "op8-rows")
    found = keyed(rows.select("__row", F.explode("__found").alias("o")).select("__row", "o.*"))
    candidates = rows.agg(F.sum(F.size("__found"))).first()[0] or 0
    good = patterns(found, texts, max(rows.sparkSession.sparkContext.defaultParallelism, len(SIDES) * candidates // EDGES))
    read, rows = rows.rdd.getNumPartitions(), rows.drop("__found")
    if good.isEmpty():
        return rows.drop("__row").withColumn("context", F.array().cast(_SPANS))
    reached = sides(dealt(found.filter(~F.col("seed")), good, ["form", "key"], ["__row", "start"]), ["__row", "start", "end"])
    reached = reached.filter((1 - F.col("left") * F.col("right") * F.col("shape") >= score) & (1 - F.col("left") * F.col("right") >= score / 2))
    added = reached.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    return rows.join(added, "__row", "left").withColumn("context", F.coalesce("context", F.array().cast(_SPANS))).drop("__row").coalesce(max(read, 1))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as listed, then by start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def redacted(text: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first one, in brackets. Needs the columns of find()."""
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    marked = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"], F.lit(k.upper()).alias("kind")))
    every = F.array_sort(F.concat(*[marked(k) for k in (*KINDS, "context")])).cast(kind)
    value = F.coalesce(text, F.lit(""))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(value, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(value, (acc["at"] + 1).cast("int"), F.length(value)))
    return F.when(text.isNotNull(), F.when(F.size(every) > 0, F.aggregate(every, zero, step, rest)).otherwise(text))
