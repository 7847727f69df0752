"""Where a text belongs: phrases and words of many profiles sought in many texts at once, and domains of questions and of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrays import let
from marlstone.functions.numeric import quantise
from marlstone.functions.text import tokens
from marlstone.operators.policy import variants
from marlstone.sources.tables import materialize

#: Words that route nothing, those that say little, and what a match of a phrase and of a word weighs, by kind.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "with", "this", "that", "into", "about",
    "can", "do", "does", "our", "their", "these", "those", "use", "used", "using", "we", "you",
)
GENERIC = (
    "ai", "agent", "agents", "artificial", "benchmark", "benchmarks", "data", "dataset", "deep", "evaluation", "foundation", "framework", "intelligence", "language", "learning", "llm", "machine", "method", "methods",
    "model", "modeling", "models", "multi", "network", "networks", "neural", "paper", "performance", "quantitative", "research", "series", "system", "systems", "task", "tasks", "time", "training", "visual", "vision",
)
PHRASES, WORDS, PLAIN = {"core": 5.0, "alias": 5.0, "adjacent": 2.5, "negative": -4.0}, {"core": 0.8, "alias": 0.7, "adjacent": 0.3, "negative": -2.0}, {"negative": -0.5}
#: What a generic word adds, and the scores from which a match is strong, a child profile, or moderate.
GENERIC_WORD, STRONG, CHILD, MODERATE = 0.1, 5.0, 4.0, 2.0

#: Words that ask for several domains, and a domain's least score, its lead, the weights of its terms and of the evidence's.
CROSSING = ("关系", "关联", "结合", "对比", "比较", "区别", "差异", "vs", "versus", "compare", "comparison", "relationship", "between", "combine", "integration")
LEAST, LEAD = 0.35, 0.15
#: Letters of all needles up to which they are broadcast.
BROADCAST = 16_000_000
#: Bits of a whole number that tell which terms were found, a multiple of those that are looked up at once; pairs of a text and a wiki that a task has at most.
BITS, CHUNK, PAIRS = 63, 3, 1 << 20
#: Domains at most: profiles of domains are a short list that goes to every row.
DOMAINS = 200


def route_tokens(text: Column) -> Column:
    return tokens(text, 2, STOP)


def words(text: Column) -> Column:
    """Words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _needles(profiles: DataFrame) -> DataFrame:
    """(wiki, kind, term, phrase): the phrases and words of profiles (wiki, kind, phrase). A phrase of generic words or stop words alone tells nothing, but for a negative one."""
    told = profiles.filter("wiki IS NOT NULL AND kind IS NOT NULL").select("wiki", "kind", words(F.col("phrase")).alias("words")).filter(F.size("words") > 0)
    told = told.select("wiki", "kind", F.array_join("words", " ").alias("phrase")).withColumn("held", route_tokens(F.col("phrase")))
    of = lambda term, phrase: F.struct(term.alias("term"), F.lit(phrase).alias("phrase"))
    telling = (F.col("kind") == "negative") | ((F.size("held") > 0) & ~((F.size("held") == 1) & F.get("held", F.lit(0)).isin(*GENERIC)))
    both = F.concat(F.filter(F.array(of(F.col("phrase"), True)), lambda _: telling), F.transform("held", lambda term: of(term, False)))
    return told.select("wiki", "kind", F.inline(both)).distinct()


def _runs(text: Column, lengths: list[int]) -> Column:
    """The runs of so many words that a text holds, each once; one of a word more than another is made of that."""

    def more(ws: Column, left: list[int], made: list[Column]) -> Column:
        if not left:
            return F.array_distinct(F.flatten(F.array(*made))) if made else F.array().cast("array<string>")
        m = left[0]
        if m == 1:
            run = ws
        elif m == 2 or m - 1 in lengths:
            run = F.array_compact(F.zip_with(ws if m == 2 else made[-1], F.slice(ws, m, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
        else:
            run = F.when(F.size(ws) >= m, F.transform(F.sequence(F.lit(1), F.size(ws) - m + 1), lambda i: F.array_join(F.slice(ws, i, m), " "))).otherwise(F.array().cast("array<string>"))
        return let(run, lambda r: more(ws, left[1:], [*made, r]))

    return let(words(text), lambda ws: more(ws, lengths, []))


def _sought(texts: DataFrame, key: str, places: dict[str, Column], needles: DataFrame, lengths: list[int]) -> DataFrame:
    """The needles (term, phrase, ...) that each of some places of a row holds, by their names, with the row's key and `at`.

    A text's runs of as many words as some phrase has, and its words in all their forms, are made once for the row and joined with the needles by equality; no
    profile is held against a text otherwise.
    """
    forms = lambda text: F.array_distinct(F.flatten(F.transform(route_tokens(F.array_join(F.array_distinct(words(text)), " ")), variants)))
    told = [F.struct(F.lit(at).alias("at"), F.lit(phrase).alias("phrase"), made.alias("terms")) for at, text in places.items() for phrase, made in ((True, _runs(text, lengths)), (False, forms(text)))]
    held = texts.select(key, F.inline(F.array(*told))).select(key, "at", "phrase", F.explode("terms").alias("term"))
    return held.join(needles, ["term", "phrase"])


def _measured(needles: DataFrame) -> tuple[list[int], bool]:
    """How many words phrases have, and whether needles have few letters enough to be broadcast, so that runs aren't shuffled; beyond that they are."""
    size = F.size(F.split("term", " "))
    sizes = {r.n: r.letters for r in needles.groupBy(F.when(F.col("phrase"), size).alias("n")).agg(F.sum(F.length("term") + F.length("wiki")).alias("letters")).collect()}
    return sorted(n for n in sizes if n is not None), sum(sizes.values()) <= BROADCAST


def matches(texts: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """(key, wiki, kind, term, phrase, generic): the phrases and words of profiles (wiki, kind, phrase) that texts hold, each once."""
    needles = materialize(_needles(profiles), "needles")
    lengths, few = _measured(needles)
    found = _sought(texts, key, {"text": F.col(text)}, F.broadcast(needles) if few else needles, lengths)
    return found.select(key, "wiki", "kind", "term", "phrase", (~F.col("phrase") & F.col("term").isin(*GENERIC)).alias("generic"))


def _wikis(needles: DataFrame) -> DataFrame:
    """(id, wiki, positives, negatives): wikis, numbered in the order of their names, each with the terms in and out of its scope, in order."""
    sets = needles.groupBy("wiki").agg(*(F.array_sort(F.collect_set(F.when(test, F.col("term")))).alias(name) for name, test in (("positives", F.col("kind") != "negative"), ("negatives", F.col("kind") == "negative"))))
    return sets.orderBy("wiki").select(F.monotonically_increasing_id().alias("id"), "*")


def _weighed(needles: DataFrame, wikis: DataFrame, out: int, parts: int) -> DataFrame:
    """(term, phrase, id, weight, generic, strong, near, bits0, ...): what finding a wiki's phrase or word tells: its weight in hundredths, and whether it is a generic word, a phrase, or no generic word in its scope.

    A term's bit is its place among its wiki's; terms out of scope begin at bit `out`.
    """
    c = F.col
    weight = F.lit(0)
    for kind in PHRASES:
        plain = round(100 * PLAIN.get(kind, 0.0))
        weight = F.when(c("kind") == kind, F.when(c("phrase"), round(100 * PHRASES[kind])).when(c("term").isin(*GENERIC), plain).otherwise(round(100 * WORDS[kind]))).otherwise(weight)
    positive, plain = c("kind") != "negative", ~c("phrase") & c("term").isin(*GENERIC)
    flag = lambda test: F.max(test.cast("int"))
    told = needles.groupBy("wiki", "term", "phrase").agg(F.sum(weight.cast("long")).alias("weight"), flag(positive & plain).alias("generic"), flag(positive & c("phrase")).alias("strong"), flag(positive & ~plain).alias("near"), flag(positive).alias("in"), flag(~positive).alias("out"))
    told = told.join(wikis, "wiki").withColumn("_in", F.when(c("in") == 1, F.array_position("positives", c("term")) - 1)).withColumn("_out", F.when(c("out") == 1, F.array_position("negatives", c("term")) - 1 + out))
    of = lambda at, k: F.when(F.floor(c(at) / BITS) == k, F.get(F.array(*(F.lit(1 << n) for n in range(BITS))).cast("array<bigint>"), (c(at) % BITS).cast("int"))).otherwise(F.lit(0).cast("long"))
    return told.select("term", "phrase", "id", "weight", "generic", "strong", "near", *((of("_in", k) + of("_out", k)).alias(f"bits{k}") for k in range(parts)))


def _sets(terms: str) -> Column:
    """For each CHUNK of some terms, which of them any set of its bits stands for: array<array<array<string>>>."""
    bits = F.array(*(F.lit(1 << n) for n in range(CHUNK)))
    one = lambda some: F.transform(F.slice(F.array(*map(F.lit, range(1 << CHUNK))), F.lit(1), F.get(F.array(*(F.lit(1 << n) for n in range(CHUNK + 1))), F.size(some))), lambda m: F.filter(some, lambda _, k: F.get(bits, k).bitwiseAND(m) != 0))
    chunks = F.sequence(F.lit(1), F.size(terms), F.lit(CHUNK))
    return F.when(F.size(terms) > 0, F.transform(chunks, lambda at: one(F.slice(terms, at, CHUNK)))).otherwise(F.array().cast("array<array<array<string>>>"))


def ranked(texts: DataFrame, key: str, text: str, focus: str, profiles: DataFrame) -> DataFrame:
    """(key, wiki, score, quality, hint, terms, negatives, place): the wikis whose profile a text meets, the best first, ties by name.

    What is out of a wiki's scope counts against it. A match is strong only by a phrase; how a text relates to a wiki also hangs on what its focus holds. Wikis
    that a text shares nothing with score 0, and are no rows. Null texts are empty; keys are unique. Texts are dealt by their keys once: what they
    hold, its sums and its order stay in a text's task, so that nothing as large as the result is shuffled. Until they are put out, wikis are numbers, and the terms
    that were found are bits. A task has PAIRS of a text and a wiki at most, or a text.
    """
    c = F.col
    needles = materialize(_needles(profiles), "needles")
    lengths, few = _measured(needles)
    wikis = materialize(_wikis(needles), "wikis")
    n, *most = wikis.agg(F.count("*"), *(F.coalesce(F.max(F.ceil(F.size(name) / CHUNK)), F.lit(0)) for name in ("positives", "negatives"))).first()
    near = lambda small: F.broadcast(small) if few else small
    parts = max(1, -(-sum(most) * CHUNK // BITS))
    told = materialize(_weighed(needles, near(wikis), most[0] * CHUNK, parts), "weighed")
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * n // PAIRS))
    found = _sought(texts.select(key, text, focus).repartition(tasks, key), key, {"text": c(text), "focus": c(focus)}, near(told), lengths)
    own = c("at") == "text"
    bits = [f"bits{k}" for k in range(parts)]
    scored = found.groupBy(key, "id").agg(
        F.sum(F.when(own, c("weight"))).alias("sum"), F.sum(F.when(own, c("generic"))).alias("generic"), F.max(F.when(own, c("strong"))).alias("strong"), F.max(F.when(~own, c("near"))).alias("near"),
        *(F.bit_or(F.when(own, c(b))).alias(b) for b in bits),
    ).filter("sum IS NOT NULL")
    scored = scored.withColumn("score", F.greatest(F.lit(0.0), c("sum") / 100.0 + c("generic") * GENERIC_WORD))
    strong, child = (c("score") >= STRONG) & (c("strong") == 1), c("near") == 1
    quality = F.when(c("score") <= 0, "none").when(strong, "strong").when(c("score") >= MODERATE, "moderate").otherwise("weak")
    hint = F.when(c("score") <= 0, "unrelated").when(strong, "same_scheme").when(child & (c("score") >= CHILD), "possible_child_profile").when(child & (c("score") >= MODERATE), "adjacent_family").otherwise("generic_overlap")
    told = scored.select(key, "id", quantise(c("score"), 2).alias("score"), quality.alias("quality"), hint.alias("hint"), *bits)
    placed = told.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id")))
    chosen = lambda k: F.shiftright(f"bits{k * CHUNK // BITS}", k * CHUNK % BITS).bitwiseAND(F.lit((1 << CHUNK) - 1)).cast("int")
    none = F.array().cast("array<string>")
    terms = lambda name, at, m: F.concat(none, *(F.coalesce(F.get(F.get(name, F.lit(k)), chosen(at + k)), none) for k in range(m)))
    sets = wikis.select("id", "wiki", *(_sets(name).alias(name) for name in ("positives", "negatives")))
    return placed.join(near(sets), "id").select(key, "wiki", "score", "quality", "hint", terms("positives", 0, most[0]).alias("terms"), terms("negatives", *most).alias("negatives"), "place")


# --- domains -------------------------------------------------------------------------------------


def intent_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_/|:：,，.。;；()（）\[\]{}]+", " "), r"\s+", " "))


def profile_list(profiles: DataFrame) -> DataFrame:
    """One row `_profiles` of profiles (domain, core, support, generic, negative, focus: arrays), in the order of their domains, with normal terms; more than DOMAINS are an error."""
    normal = lambda name: F.array_distinct(F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), intent_text), lambda t: t != "")).alias(name)
    rows = profiles.select(F.struct("domain", *(normal(n) for n in ("core", "support", "generic", "focus")), F.array_distinct(F.coalesce("negative", F.array().cast("array<string>"))).alias("negative")).alias("p"))
    some = rows.agg(F.array_sort(F.collect_list("p")).alias("_profiles"))
    return some.select(F.when(F.size("_profiles") <= DOMAINS, F.col("_profiles")).otherwise(F.raise_error(F.lit(f"more than {DOMAINS} domains"))).alias("_profiles"))


def _held(text: Column, terms: Column) -> Column:
    """How many of some terms a text holds, anywhere."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def intents(questions: DataFrame, question: str, profiles: DataFrame) -> DataFrame:
    """questions with `scores` (domain, score), `dominant`, `crossing` and `focused`: what domains a question is of, the best first, ties by name.

    A domain counts by a core term, two support terms, or one with two generic ones. Dominant is what scores LEAST, and within LEAD of the best; where a question
    asks for several domains that it is of, all of these are.
    """
    rows = questions.crossJoin(F.broadcast(profile_list(profiles))).withColumn("_q", intent_text(F.col(question)))
    q = F.col("_q")

    def scored(p: Column) -> Column:
        counts = F.struct(_held(q, p["core"]).alias("core"), _held(q, p["support"]).alias("support"), _held(q, p["generic"]).alias("generic"))
        known = lambda n: (n["core"] > 0) | (n["support"] >= 2) | ((n["support"] >= 1) & (n["generic"] >= 2))
        score = let(counts, lambda n: F.when(known(n), quantise(_within(n["core"] * 0.75 + n["support"] * 0.35 + F.least(n["generic"], F.lit(2)) * 0.12), 6)).otherwise(0.0))
        return F.struct((-score).alias("below"), p["domain"].alias("domain"))

    rows = rows.withColumn("scores", F.transform(F.array_sort(F.transform("_profiles", scored)), lambda x: F.struct(x["domain"].alias("domain"), (-x["below"]).alias("score"))))
    own = F.filter("scores", lambda x: x["score"] >= LEAST)
    several = F.exists(F.array(*map(F.lit, CROSSING)), lambda t: F.contains(q, t)) & (F.size(own) > 1)
    best = F.get("scores", F.lit(0))["score"]
    lead = F.filter("scores", lambda x: (best > 0) & (x["score"] >= F.greatest(F.lit(LEAST), quantise(best - LEAD, 6))))
    rows = rows.withColumn("crossing", F.coalesce(several, F.lit(False))).withColumn("dominant", F.transform(F.when(F.col("crossing"), own).otherwise(lead), lambda x: x["domain"]))
    of = F.filter("_profiles", lambda p: F.exists(own, lambda x: x["domain"] == p["domain"]) & (_held(q, p["focus"]) > 0))
    return rows.withColumn("focused", F.transform(of, lambda p: p["domain"])).drop("_q")


def evidence_fit(rows: DataFrame, identity: Column, excerpt: Column) -> DataFrame:
    """rows of `intents` with `fit` (domain, positive, negative, margin, strong, score): how the evidence of a question fits the best of its dominant domains; the best margin first, then score.

    Core terms of the domains that a profile excludes count against it, and so does a focus that the question has and the evidence lacks. A question without a
    domain takes any evidence, half sure.
    """
    neutral = F.struct(F.lit(None).cast("string").alias("domain"), F.lit(0.5).alias("positive"), F.lit(0.0).alias("negative"), F.lit(0.5).alias("margin"), F.lit(True).alias("strong"), F.lit(0.5).alias("score"))
    held = rows.withColumn("_id", intent_text(identity)).withColumn("_full", intent_text(F.concat_ws(" ", "_id", F.coalesce(excerpt, F.lit("")))))
    own, full = F.col("_id"), F.col("_full")
    more = lambda a, b: F.greatest(F.lit(0), a - b)

    def judged(p: Column) -> Column:
        counts = F.struct(*(_held(text, p[name]).alias(f"{side}_{name}") for side, text in (("own", own), ("full", full)) for name in ("core", "support")), _held(full, p["generic"]).alias("generic"), (_held(full, p["focus"]) > 0).alias("focus"))
        others = F.filter("_profiles", lambda o: F.array_contains(p["negative"], o["domain"]))
        pressure = F.aggregate(others, F.lit(0.0), lambda sum_, o: sum_ + let(_held(own, o["core"]), lambda a: a * 0.5 + more(_held(full, o["core"]), a) * 0.25))

        def of(n: Column) -> Column:
            positive = quantise(_within(n["own_core"] * 0.7 + more(n["full_core"], n["own_core"]) * 0.4 + n["own_support"] * 0.25 + more(n["full_support"], n["own_support"]) * 0.15 + F.least(n["generic"], F.lit(2)) * 0.05), 6)
            lacking = F.when(F.array_contains("focused", p["domain"]) & ~n["focus"], 0.35).otherwise(0.0)
            negative = quantise(_within(_within(pressure) + lacking), 6)
            known = (n["own_core"] > 0) | (n["full_core"] > 0) | (n["own_support"] + n["full_support"] >= 2)
            return let(F.struct(positive.alias("p"), negative.alias("n"), known.alias("k")), lambda x: F.struct(p["domain"].alias("domain"), x["p"].alias("positive"), x["n"].alias("negative"), quantise(x["p"] - x["n"], 6).alias("margin"), (x["k"] & (quantise(x["p"] - x["n"], 6) >= 0.25) & (x["p"] >= 0.45)).alias("strong"), quantise(_within(x["p"] - x["n"]), 6).alias("score")))

        return let(counts, of)

    fits = F.transform(F.filter("_profiles", lambda p: F.array_contains("dominant", p["domain"])), judged)
    order = F.transform(fits, lambda f: F.struct((-f["margin"]).alias("a"), (-f["score"]).alias("b"), (~f["strong"]).alias("c"), f["domain"].alias("d"), f.alias("fit")))
    return held.withColumn("fit", F.coalesce(F.get(F.array_sort(order), F.lit(0))["fit"], neutral)).drop("_id", "_full")
