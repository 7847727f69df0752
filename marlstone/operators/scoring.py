"""Templates scored for questions: points of phrases and words over a long table of evidence, capped by field, with the reasons kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise
from marlstone.operators.catalog import grams
from marlstone.sources.tables import materialize

#: Words and Han runs that tell nothing of a request, and terms too weak for a profile.
STOP = (
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "have", "has", "are", "not", "but", "you", "use", "using", "used", "make", "made", "create", "design", "show", "want", "need", "over",
    "than", "then", "onto", "their", "there", "here", "such", "very", "more", "less", "just", "only", "also", "about", "after", "before", "while", "where", "when", "what", "which", "whose", "without", "within",
    "does", "done", "each", "per", "via", "its", "our", "out", "off", "all", "any", "can", "may", "should", "will", "would", "could", "render", "image", "reference", "references", "scene",
    "生成", "一张", "一个", "一组", "风格", "风格的", "包含", "整体", "画面", "要求", "输入", "输出", "模板", "背景", "主体", "设计", "图片", "内容", "结构", "视觉", "说明", "需要", "不要", "使用", "可以", "用于", "默认", "参数", "信息",
    "效果", "感觉", "元素", "生成一", "成一张", "生成一张", "设计一", "计一张", "设计一张", "整体视", "体视觉", "整体视觉", "参考", "这个", "那个", "这张", "那张", "场景",
)
WEAK = ("用户", "清晰", "可读", "任务", "系统", "结构", "风格", "要求", "内容", "展示", "user", "clear", "readable", "task", "system", "structure", "style")

#: Points of a phrase, of a word, and the most of a field, by part and field. Points below 0 speak against an item.
FIELDS = {
    ("own", "category"): (30, 6, 30), ("own", "category-title"): (26, 5, 26), ("own", "category-description"): (14, 2, 14),
    ("own", "style"): (20, 5, 20), ("own", "style-title"): (16, 4, 16), ("own", "style-keyword"): (10, 3, 12),
    ("own", "scene"): (16, 4, 16), ("own", "scene-title"): (14, 4, 14), ("own", "scene-keyword"): (8, 3, 10),
    ("own", "tag"): (10, 3, 12), ("own", "template-title"): (14, 4, 14), ("own", "template-id"): (12, 5, 12),
    ("own", "use-when"): (10, 3, 10), ("own", "guidance"): (6, 2, 8), ("own", "prompt-section"): (16, 4, 18),
    ("variant", "label"): (14, 5, 18), ("variant", "notes"): (8, 3, 12), ("variant", "prompt"): (10, 2, 14),
    **{(part, field): points for part in ("exact", "candidate") for field, points in (("title", (14, 4, 18)), ("preview", (8, 2, 10)), ("prompt", (6, 1, 10)), ("style", (4, 2, 6)), ("scene", (4, 2, 6)))},
    ("canonical", "path"): (10, 6, 14), ("canonical", "title"): (18, 6, 22), ("canonical", "snippet"): (10, 2, 18),
    ("canonical", "negative"): (-10, -2, -8), ("canonical", "redirect"): (-24, -5, -24),
}
#: How many items of a part count, the most and the least that one adds, and what a question that says just a case's text adds.
PARTS = {"variant": (3, 18, 0), "exact": (3, 18, 0), "candidate": (2, 6, 0), "canonical": (2, 20, 0)}
SAME = {"exact": 24, "candidate": 14}
#: What items have before any question, the most that a case's prior points add, what a mapping's confidence adds, and the most that the number of a part's items adds.
BASE, PRIOR, CONFIDENCE, COUNTS = {"exact": 8, "candidate": 2}, 8, {"high": 4, "medium": 2}, {"variant": 3, "exact": 4, "canonical": 4}
#: Letters of a phrase by which it is sought at most, and templates of a catalogue at most: it is a curated list, whose fixed points every question is ranked by.
ANCHOR, TEMPLATES = 8, 10_000
#: Letters of all needles up to which they are broadcast, and how many beginnings of needles a text's runs are compared with in its own row.
BROADCAST, IN_ROW = 4_000_000, 2_000
#: Templates up to which a question is held against each of them in its own row, and how many questions make a task.
CROSSED, ASKED = 100, 2_000

#: Dimensions of a profile, points of a term and the most of a dimension, and the weights of dimensions in roles, in the order in which roles are tried.
DIMENSIONS = ("purpose", "content", "structure", "style", "constraints")
TERM, POSITIVE, BONUS = (12, 36), (14, 56), 8
ROLES = {
    "primary": {"purpose": 1.4, "content": 1.6, "structure": 1.5, "style": 0.6, "positive": 1.0},
    "supporting": {"content": 1.2, "structure": 1.1, "purpose": 0.8, "positive": 0.7},
    "style": {"style": 1.8, "purpose": 0.5, "positive": 0.5},
    "constraint": {"constraints": 2.0, "positive": 0.3},
}


def said(text: Column) -> Column:
    """Lower case, straight quotes, single spaces; null is empty."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for curly, straight in zip("‘’“”", "''\"\"", strict=True):
        plain = F.replace(plain, F.lit(curly), F.lit(straight))
    return F.trim(F.regexp_replace(plain, r"[\s ]+", " "))


def query_tokens(text: Column) -> Column:
    """Words and runs of a text; quotes and spaces are parts of none, so they stay as they are."""
    return grams(text, STOP)


def contained(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(key, needle): the distinct needles of two letters or more that a text holds anywhere, not at words' bounds alone.

    A needle is sought by its first 2, 4 or 8 letters, the most that it has, which are joined by equality with the runs of as many letters that a text has (found in one pass for each
    length, by looking ahead); the text then decides. So a text meets only needles that begin somewhere in it, and isn't copied for its runs. Needles of BROADCAST letters in all are
    broadcast, so that runs which begin none aren't shuffled; beyond that they are. Where needles have no more than IN_ROW beginnings, a text's other runs are left out before they are rows.
    """
    size = F.when(F.length(needle) >= ANCHOR, ANCHOR).when(F.length(needle) >= 4, 4).otherwise(2)
    wanted = needles.select(needle).filter(F.length(needle) > 1).distinct().withColumn("_anchor", F.left(needle, size))
    told = wanted.groupBy(F.length("_anchor").alias("n")).agg(F.sum(F.length(needle)).alias("letters"), F.count_distinct("_anchor").alias("anchors")).collect()
    lengths = sorted(r.n for r in told)
    if not lengths:
        return texts.select(key, F.lit("").alias(needle)).limit(0)
    windows = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{m}}}))"), F.lit(1)) for m in lengths)))
    if sum(r.anchors for r in told) <= IN_ROW:
        windows = F.array_intersect(windows, F.array(*(F.lit(r._anchor) for r in wanted.select("_anchor").distinct().collect())))
    else:
        windows = F.array_distinct(windows)
    if sum(r.letters for r in told) <= BROADCAST:
        wanted = F.broadcast(wanted)
    met = texts.select(key, F.explode(windows).alias("_anchor")).join(wanted, "_anchor").drop("_anchor")
    return met.join(texts.select(key, text), key).filter(F.contains(text, needle)).select(key, needle)


def _small(rows: DataFrame, *texts: str) -> DataFrame:
    """Rows to be broadcast if their texts have at most BROADCAST letters, counting 64 more a row; else as they are."""
    size = rows.agg(F.sum(sum((F.length(t) for t in texts), F.lit(64)))).first()[0]
    return F.broadcast(rows) if (size or 0) <= BROADCAST else rows


def _asked(questions: DataFrame, key: str, question: str) -> DataFrame:
    """(key, _q, _terms), by key, in tasks of about ASKED questions: what is found in a question stays in its task, so that only questions are shuffled, not what they have in common with fields."""
    tasks = max(questions.sparkSession.sparkContext.defaultParallelism, questions.count() // ASKED + 1)
    asked = questions.select(key, said(F.col(question)).alias("_q")).filter("_q <> ''").repartition(tasks, key)
    return asked.withColumn("_terms", query_tokens(F.col("_q")))


def _sought(asked: DataFrame, key: str, told: DataFrame) -> DataFrame:
    """(key, _t): questions and the numbers of the templates that they share a word or a phrase with, each once."""
    each = told.select("_t", F.inline("_fields"))
    texts = _small(each.select("_text", "_t").distinct(), "_text")
    terms = _small(told.select("_t", F.explode("_words").alias("term")), "term")
    shared = asked.select(key, F.explode("_terms").alias("term")).join(terms, "term").select(key, "_t")
    asked = asked.select(key, "_q")
    within = contained(asked, key, "_q", texts, "_text").join(texts, "_text").select(key, "_t")
    # What is held by a field is no longer than the longest.
    short = asked.filter(F.length("_q") <= (each.agg(F.max(F.length("_text"))).first()[0] or 0))
    around = contained(each.select("_text", F.col("_text").alias("_in")).distinct(), "_text", "_in", short, "_q").join(texts, "_text").join(short, "_q").select(key, "_t")
    same = asked.join(texts.withColumnRenamed("_text", "_q"), "_q").select(key, "_t")
    return shared.union(within).union(around.repartition(key)).union(same).distinct()


def _met(questions: DataFrame, key: str, question: str, fields: DataFrame) -> DataFrame:
    """(key, _q, target, tokens, _text, more): the fields (target, _text, _tokens, more) of a template beside each question that shares a word or a phrase with any of them, and the words of the field that the question has.

    Each question is held against CROSSED templates in its own row, so that nothing it has in common with them is shuffled, sorted or kept; of more templates it meets those that are sought for it.
    A template is one row, so its words are sought in a question once for all its fields.
    """
    rest = [F.col(c) for c in fields.columns if c != "target"]
    told = fields.distinct().groupBy("target").agg(F.collect_list(F.struct(*rest)).alias("_fields"))
    told = told.withColumn("_words", F.array_distinct(F.flatten(F.transform("_fields", lambda x: x["_tokens"])))).withColumn("_t", F.monotonically_increasing_id())
    told = materialize(told, "template-fields")
    size = told.agg(F.count("*").alias("n"), F.sum(F.aggregate("_fields", F.lit(0), lambda n, x: n + F.length(x["_text"]) + 64)).alias("letters")).first()
    asked = _asked(questions, key, question)
    if size.n <= CROSSED and (size.letters or 0) <= BROADCAST:
        pairs = asked.crossJoin(F.broadcast(told.drop("_t")))
    else:
        pairs = _sought(asked, key, told).join(asked, key).join(F.broadcast(told) if (size.letters or 0) <= BROADCAST else told, "_t")
    held = pairs.select(key, "_q", "target", F.array_intersect("_words", "_terms").alias("_held"), "_fields")
    shared = F.transform("_fields", lambda x: F.array_intersect(x["_tokens"], F.col("_held")))
    each = held.select(key, "_q", "target", F.inline(F.arrays_zip(F.col("_fields").alias("_field"), shared.alias("tokens"))))
    return each.select(key, "_q", "target", *(F.col(f"_field.{c}") for c in fields.columns if c not in ("target", "_tokens")), "tokens")


def points(questions: DataFrame, key: str, question: str, fields: DataFrame, reasons: bool = True) -> DataFrame:
    """(key, target, part, item, field, points, phrase, same, tokens): what the fields (target, part, item, field, text) of templates have in common with questions.

    A field scores by its phrase, where the question holds it or is held by it, and by its words that the question has, up to the field's cap. What speaks against an
    item counts by its phrase, else by its words. A question that is just the text of a case adds to it. Null texts and fields of no known part are left out, repeated rows count once;
    keys are unique. Templates are written once. Without reasons there is no column of tokens; they are only counted.
    """
    c = F.col
    spec = F.create_map(*(x for (part, field), (a, b, cap) in FIELDS.items() for x in (F.lit(f"{part}/{field}"), F.struct(F.lit(a).alias("phrase"), F.lit(b).alias("word"), F.lit(cap).alias("cap")))))
    told = fields.select("target", "part", "item", "field", said(c("text")).alias("_text"), F.try_element_at(spec, F.concat_ws("/", "part", "field")).alias("_spec"))
    told = told.filter("_text <> '' AND _spec IS NOT NULL").withColumn("_tokens", F.array_sort(query_tokens(c("_text"))))
    within = (F.length("_text") > 1) & F.contains("_q", "_text")
    # The length of a question is counted letter by letter, so it comes last.
    around = (c("_spec.phrase") > 0) & F.contains("_text", "_q") & (F.length("_q") > 1)
    same = c("part").isin(*SAME) & c("field").isin("title", "preview", "prompt") & (c("_q") == c("_text"))
    found = _met(questions, key, question, told).withColumn("phrase", within | around).withColumn("same", F.coalesce(same, F.lit(False))).withColumn("_n", F.size("tokens"))
    found = found.filter("_n > 0 OR phrase OR same")
    good = F.least(F.when(c("phrase"), c("_spec.phrase")).otherwise(0) + c("_n") * c("_spec.word"), c("_spec.cap"))
    bad = F.when(c("phrase"), c("_spec.phrase")).otherwise(F.greatest(c("_spec.cap"), c("_n") * c("_spec.word")))
    return found.select(key, "target", "part", "item", "field", F.when(c("_spec.phrase") > 0, good).otherwise(bad).alias("points"), "phrase", "same", *(["tokens"] if reasons else []))


def catalogue(templates: DataFrame, items: DataFrame) -> DataFrame:
    """(target, part, item, base) of templates (target, confidence) and their items (target, part, item, prior): what each has whatever the question is. Items of templates that aren't there, and of no known part, are left out."""
    c = F.col
    told = items.filter(c("part").isin(*PARTS)).groupBy("target", "part", "item").agg(F.max("prior").alias("prior"))
    prior = F.greatest(F.lit(0), F.least(F.lit(PRIOR), F.coalesce("prior", F.lit(0))))
    each = told.select("target", "part", "item", F.when(c("part") == "exact", BASE["exact"]).when(c("part") == "candidate", prior + BASE["candidate"]).otherwise(0).cast("long").alias("base"))
    counts = told.groupBy("target").agg(*(F.least(F.lit(most), F.count(F.when(c("part") == part, 1))).alias(part) for part, most in COUNTS.items()))
    sure = F.coalesce(*(F.when(c("confidence") == name, more) for name, more in CONFIDENCE.items()), F.lit(0))
    named = templates.filter("target IS NOT NULL").groupBy("target").agg(F.max(sure).alias("sure"))
    own = named.join(counts, "target", "left").select("target", F.lit("own").alias("part"), F.lit("").alias("item"), (c("sure") + sum((F.coalesce(part, F.lit(0)) for part in COUNTS), F.lit(0))).cast("long").alias("base"))
    return own.union(each.join(named.select("target"), "target", "left_semi"))


def item_scores(found: DataFrame, key: str) -> DataFrame:
    """(key, target, part, item, score) of `points`: sums by item, with what a case gains once by being said as it is."""
    bonus = F.create_map(*(x for part, more in SAME.items() for x in (F.lit(part), F.lit(more))))
    return found.groupBy(key, "target", "part", "item").agg((F.sum("points") + F.max(F.when(F.col("same"), F.coalesce(F.try_element_at(bonus, "part"), F.lit(0))).otherwise(0))).alias("score"))


def rule_points(questions: DataFrame, key: str, question: str, rules: DataFrame) -> DataFrame:
    """(key, target, part, item, score) of rules (target, rule, term, points): a rule adds its points once where a question holds any of its terms, or has it as a word. A guard's penalty is its template's base."""
    told = rules.select("target", "rule", "points", said(F.col("term")).alias("_text")).filter("_text <> ''").withColumn("_tokens", F.array("_text"))
    held = _met(questions, key, question, told).filter((F.size("tokens") > 0) | ((F.length("_text") > 1) & F.contains("_q", "_text")))
    met = held.select(key, "target", "rule", "points").distinct()
    return met.groupBy(key, "target").agg(F.sum("points").alias("score")).select(key, "target", F.lit("own").alias("part"), F.lit("").alias("item"), "score")


def item_ranks(questions: DataFrame, key: str, scored: DataFrame, entries: DataFrame, part: str) -> DataFrame:
    """(key, target, item, score, place): the best items of a part for a question, as many as count, ties by item; only templates that a question shares an item of the part with."""
    c = F.col
    item = lambda score, known: F.collect_list(F.struct("item", c(score).cast("long").alias("score"), F.lit(known).alias("known")))
    held = entries.filter(c("part") == part).groupBy("target", "item").agg(F.sum("base").alias("base")).groupBy("target").agg(item("base", True).alias("_base"))
    more = scored.filter(c("part") == part).groupBy(key, "target").agg(item("score", False).alias("_more"))
    pairs = more.join(held, "target").select(key, "target", F.inline(F.concat("_more", "_base"))).groupBy(key, "target", "item")
    # What is added to an item without a name is no one's.
    total = pairs.agg(F.sum(F.when(c("known") | c("item").isNotNull(), c("score"))).alias("score"), F.max("known").alias("known")).filter("known").drop("known")
    placed = total.withColumn("place", F.row_number().over(Window.partitionBy(key, "target").orderBy(F.desc("score"), "item")))
    return placed.filter(F.col("place") <= PARTS[part][0]).join(questions.select(key), key, "left_semi")


def _total(items: Column) -> Column:
    """A template's score by those of its items, array<struct<part, score>>: all of its own, and the best of each part, as many and as much as PARTS says."""

    def best(part: str, top: int, most: int, least: int) -> Column:
        each = F.transform(F.filter(items, lambda x: x["part"] == part), lambda x: F.greatest(F.least(x["score"], F.lit(most)), F.lit(least)))
        return F.slice(F.sort_array(each, asc=False), 1, top)

    own = F.transform(F.filter(items, lambda x: ~F.coalesce(x["part"].isin(*PARTS), F.lit(False))), lambda x: x["score"])
    return F.aggregate(F.concat(own, *(best(part, *rule) for part, rule in PARTS.items())), F.lit(0).cast("long"), lambda s, x: s + x)


def ranked(questions: DataFrame, key: str, scored: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """(key, target, score, place): the n best templates above 0 for each question, ties by target.

    entries (target, part, item, base) is the whole catalogue; `scored` holds what questions add to its items. A template's score is that of its own, and of the
    best items of each part, as many and as much as PARTS says. Templates that a question shares nothing with have a score that is fixed, so the first of their
    list that it didn't meet stand for them; no question meets the whole catalogue. More than TEMPLATES are an error.
    """
    base = entries.groupBy("target", "part", "item").agg(F.sum("base").alias("base"))

    def totals(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.collect_list(F.struct("part", "score")).alias("_all")).select(*by, _total(F.col("_all")).alias("score"))

    fixed = totals(base.withColumnRenamed("base", "score"), ["target"])
    order = lambda score: F.struct((-score).alias("below"), F.col("target"))
    one = fixed.agg(F.array_sort(F.collect_list(order(F.col("score")))).alias("_all"))
    one = one.select(F.when(F.size("_all") <= TEMPLATES, F.col("_all")).otherwise(F.raise_error(F.lit(f"more than {TEMPLATES} templates"))).alias("_fixed"))
    item = lambda score, known: F.collect_list(F.struct("part", "item", F.col(score).cast("long").alias("score"), F.lit(known).alias("known")))
    held = base.groupBy("target").agg(item("base", True).alias("_base"))
    held = F.broadcast(held) if base.count() * 64 <= BROADCAST else held
    every = scored.groupBy(key, "target").agg(item("score", False).alias("_more")).join(held, "target").select(key, "target", F.inline(F.concat("_more", "_base")))
    pairs = every.groupBy(key, "target", "part", "item").agg(F.sum("score").alias("score"), F.max("known").alias("known")).filter("known")
    own = totals(pairs, [key, "target"])
    met = own.groupBy(key).agg(F.collect_list(order(F.col("score"))).alias("_met"))
    rows = questions.select(key).join(met, key, "left").crossJoin(F.broadcast(one))
    none = F.slice("_fixed", 1, 0)
    known = F.transform(F.coalesce("_met", none), lambda x: x["target"])
    rest = F.filter(F.slice("_fixed", F.lit(1), F.size(known) + n), lambda x: ~F.array_contains(known, x["target"]))
    best = F.slice(F.array_sort(F.filter(F.concat(F.coalesce("_met", none), rest), lambda x: x["below"] < 0)), 1, n)
    return rows.select(key, F.posexplode(best).alias("place", "t")).select(key, F.col("t.target").alias("target"), (-F.col("t.below")).alias("score"), (F.col("place") + 1).cast("long").alias("place"))


# --- profiles ------------------------------------------------------------------------------------


def profile_scores(questions: DataFrame, key: str, question: str, profiles: DataFrame) -> DataFrame:
    """(key, target, score, primary_score, roles, assigned, negative_for, hits): profiles (target, dimension, term) with their roles, as `composition.compose` takes them.

    profiles: (target, roles, negative_for, terms: array of (dimension, term)). A plain term must stand as a word, other terms anywhere; weak ones count nowhere. A profile's
    score is that of its best role among those it may have. Only profiles that share a term with a question are rows.
    """
    c = F.col
    told = profiles.select("target", "roles", F.inline("terms")).select("target", "dimension", F.trim("term").alias("term"), said(c("term")).alias("_text"))
    told = told.filter((c("_text") != "") & ~c("_text").isin(*WEAK)).distinct()
    asked = questions.select(key, said(c(question)).alias("_q")).filter("_q <> ''")
    plain = told.filter(c("_text").rlike(r"^[a-z0-9][a-z0-9+\- ]*$"))
    other = told.join(plain.select("_text").distinct(), "_text", "left_anti")
    bounded = F.concat(F.lit(" "), F.regexp_replace("_q", r"[^a-z0-9]+", " "), F.lit(" "))
    flat = asked.select(key, bounded.alias("_flat"))
    flats = plain.select("_text", F.concat(F.lit(" "), F.regexp_replace("_text", r"[^a-z0-9]+", " "), F.lit(" ")).alias("_needle"))
    sure = contained(flat, key, "_flat", flats, "_needle").join(flats.distinct(), "_needle").select(key, "_text").distinct()
    # Signs and spaces within a term are spaces in what it was sought by, so the text itself decides.
    exact = F.expr(r"regexp_like(_q, concat('(^|[^a-z0-9])\\Q', _text, '\\E([^a-z0-9]|$)'))")
    sure = sure.filter(~c("_text").rlike("[-+ ]")).union(sure.filter(c("_text").rlike("[-+ ]")).join(asked, key).filter(exact).select(key, "_text"))
    hits = sure.union(contained(asked, key, "_q", other, "_text")).distinct().join(told, "_text").groupBy(key, "target").agg(
        *(F.count_distinct(F.when(c("dimension") == d, c("term"))).alias(d) for d in (*DIMENSIONS, "positive")), F.count_distinct("dimension", "term").alias("hits"))
    rows = hits.join(profiles.select("target", "roles", "negative_for"), "target")
    of = {d: F.least(F.lit(TERM[1]), c(d) * TERM[0]) for d in DIMENSIONS} | {"positive": F.least(F.lit(POSITIVE[1]), c("positive") * POSITIVE[0])}
    extra = F.least(F.lit(12), (c("hits") - 1) * 2)
    for role, weights in ROLES.items():
        score = sum((of[d] * w for d, w in weights.items()), F.lit(0.0))
        more = F.when(F.array_contains("roles", "primary"), BONUS).otherwise(0) if role == "primary" else F.lit(0)
        rows = rows.withColumn(f"_{role}", quantise(score + more + extra, 1))
    place = {role: k for k, role in enumerate(ROLES)}
    best = F.array_sort(F.filter(F.array(*(F.struct((-c(f"_{r}")).alias("below"), F.lit(k if r != "supporting" else -1).alias("place"), F.lit(r).alias("role")) for r, k in place.items())), lambda x: F.array_contains("roles", x["role"])))
    found = rows.withColumn("_best", F.get(best, F.lit(0)))
    return found.select(
        key, "target", F.coalesce(-c("_best.below"), c("_supporting")).alias("score"), c("_primary").alias("primary_score"), "roles", F.coalesce("_best.role", F.lit("supporting")).alias("assigned"), "negative_for", "hits"
    )
