"""The graph of what chunks speak of: concepts of each chunk, edges where they stand together, and edges by links, taxonomies and extracted relations.

Provenance stays rows: which chunk names a node (`concepts`), and which pages speak for an edge, so that a node that every chunk names is never gathered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrays import let
from marlstone.functions.numeric import quantise
from marlstone.functions.text import tokens
from marlstone.sources.tables import materialize

#: Words that are no concepts; concepts of a chunk and, for a link, of a page at most; and what each source of a concept or an edge weighs.
STOP = (
    "about", "after", "also", "and", "are", "based", "been", "before", "between", "chunk", "content", "data", "default", "does", "evidence", "from", "have", "into", "more", "not", "page", "query", "retrieval", "section",
    "should", "source", "that", "the", "this", "with", "without", "一个", "不是", "以及", "可以", "当前", "证据", "来源", "问题", "需要",
)
TOP, LINKED = 8, 5
TITLE, HEADING, LINK, NAME, WORD = 2.5, 1.5, 1.25, 1.0, 0.25
TOGETHER, LINKED_PAGES, TOPICS, RELATED, EXTRACTED = 1.0, 0.75, 0.6, 1.25, 2.0

_NAMES = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]*(?:[- ][A-Z][A-Za-z0-9]*){0,4}(?![A-Za-z0-9_])"


def concept_name(value: Column) -> Column:
    """A name in lower case, words and camelCase parts joined by dashes, without the folder that it stands in."""
    bare = F.regexp_replace(F.regexp_replace(value, "^concepts/", ""), "^sources/", "")
    parted = F.regexp_replace(F.regexp_replace(bare, "[#_]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(parted)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def _told(title: Column, section: Column, headings: Column, links: Column, text: Column) -> Column:
    """struct<named: array<struct<label, kind, weight, name>>, names: array<string>, words: array<string>>: all that a chunk names, in order: title, headings and links; names in capitals; words."""
    one = lambda label, kind, weight: F.struct(F.trim(label).alias("label"), kind.alias("kind"), F.lit(weight).alias("weight"), concept_name(label).alias("name"))
    each = lambda labels, kind, weight: F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: one(x, F.lit(kind), weight))
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "`[^`]+`", " ")
    last = F.coalesce(F.get(headings, F.size(headings) - 1), F.lit(""))

    def of(said: Column) -> Column:
        words = tokens(F.concat_ws(" ", F.coalesce(title, F.lit("")), last, said), 4)
        targets = F.transform(links, lambda x: F.substring_index(x, "#", 1))
        named = F.concat(F.array(one(F.coalesce(title, F.lit("")), F.when(section == "concepts", "concept").otherwise("topic"), TITLE)), each(headings, "concept", HEADING), each(targets, "concept", LINK))
        return F.struct(named.alias("named"), F.regexp_extract_all(said, F.lit(_NAMES), F.lit(0)).alias("names"), words.alias("words"))

    return let(bare, of)


def ambiguous(chunks: DataFrame) -> DataFrame:
    """(slug) of slugs that stand in several sections."""
    return chunks.groupBy("slug").agg(F.min("section").alias("_a"), F.max("section").alias("_b")).filter("_a <> _b").select("slug")


def _counted(chunks: DataFrame, most: int | None) -> DataFrame:
    """(chunk, page, id, kind, label, name, weight, rank, seq): the concepts of each row, counted where the row is; the `most` heaviest of them, or all."""

    known: dict[str, str] = {}

    def plain_name(label: str) -> str:
        """concept_name of ASCII letters and digits with single blanks or dashes between."""
        if label not in known:
            if len(known) >= 100_000:
                known.clear()
            known[label] = re.sub("([a-z])([A-Z])", r"\1 \2", label).lower().replace(" ", "-")
        return known[label]

    def concepts_of(named: list[dict], names: list[str], words: list[str]) -> list[tuple]:
        found: dict[str, list] = {}
        for seq, (label, kind, weight, name) in enumerate(chain((tuple(x.values()) for x in named), ((x, "entity", NAME, plain_name(x)) for x in names))):
            if name is None or len(name) < 3 or name in STOP:
                continue
            id = ("topic:" if kind == "topic" else "concept:") + name
            if id in found:
                found[id][5] += weight
            else:
                found[id] = [id, kind, label, name, seq, weight]
        # a token is in lower case and has letters, numbers and single blanks, so that only the blanks differ in its name
        counts = Counter(words)
        for word in STOP:
            counts.pop(word, None)
        for id, one in found.items():
            if id.startswith("concept:"):
                one[5] += WORD * counts.pop(one[3].replace("-", " "), 0)
        least = sorted(counts.values(), reverse=True)[most - 1] if most is not None and len(counts) > most else 1
        more = [(f"concept:{w.replace(' ', '-')}", "concept", w, w.replace(" ", "-"), -1, WORD * n) for w, n in counts.items() if n >= least]
        ordered = sorted(chain(found.values(), more), key=lambda x: (-x[5], x[3], x[0]))[:most]
        return [(id, kind, label, name, weight, rank, seq if seq >= 0 else len(named) + len(names) + words.index(label)) for rank, (id, kind, label, name, seq, weight) in enumerate(ordered, 1)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, owner = [], []
            for row, held in enumerate(zip(*batch.columns[2:], strict=True)):
                found = concepts_of(held[0].as_py(), *(x.values.to_pylist() for x in held[1:]))
                made += found
                owner += [row] * len(found)
            at = pa.array(owner, pa.int64())
            columns = list(zip(*made, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["chunk", "page", "id", "kind", "label", "name", "weight", "rank", "seq"])

    said = chunks.select("chunk", "page", _told(F.col("title"), F.col("section"), F.col("headings"), F.col("links"), F.col("text")).alias("x")).select("chunk", "page", "x.named", "x.names", "x.words")
    kind = lambda c: chunks.schema[c].dataType.simpleString()
    return said.mapInArrow(over, f"chunk {kind('chunk')}, page {kind('page')}, id string, kind string, label string, name string, weight double, rank int, seq int")


def concepts(chunks: DataFrame) -> DataFrame:
    """(chunk, page, id, kind, label, name, weight, rank): the TOP concepts of each chunk (chunk, page, title, section, slug, headings, links, text), ties by name and id.

    Chunks of a slug that stands in several sections are left out. Short names and stop words are none. What names a concept first tells its kind and label. Null
    texts, titles, headings and links are empty. A chunk that is one row is counted and ranked where it is, so that neither texts nor words are shuffled; the concepts of one with
    several rows, or without an id, are added up. Slugs and ids that are left out are written, so that Spark knows how few they are.
    """
    kept = chunks.join(materialize(ambiguous(chunks), "ambiguous"), "slug", "left_anti")
    twice = materialize(chunks.groupBy("chunk").agg(F.count("*").alias("n")).filter("n > 1 OR chunk IS NULL").select(F.col("chunk").alias("_twice")), "twice")
    same = F.col("chunk").eqNullSafe(F.col("_twice"))
    columns = ["chunk", "page", "id", "kind", "label", "name", "weight", "rank"]
    once = _counted(kept.join(twice, same, "left_anti"), TOP).select(*columns)
    parts = _counted(kept.join(twice, same, "left_semi"), None)
    added = parts.groupBy("chunk", "page", "id", "name").agg(F.sum("weight").alias("weight"), F.min_by("label", "seq").alias("label"), F.min_by("kind", "seq").alias("kind"))
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("weight"), "name", "id"))
    return once.union(added.withColumn("rank", rank).filter(F.col("rank") <= TOP).select(*columns))


@dataclass(frozen=True)
class Graph:
    """nodes (id, kind, label, name, weight, chunks, pages, aliases), edges (a, b, kind, weight, chunks, pages, routing_only) and which chunk names a node: mentions (chunk, page, id)."""

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame


def _edge(a: Column, b: Column, kind: str, weight: float, *more: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), *more]


def build(chunks: DataFrame, links: DataFrame, topics: DataFrame, entities: DataFrame, relations: DataFrame) -> Graph:
    """The graph of chunks, resolved links (from, to) between pages, taxonomy edges (from, to), and entities (page, name) and relations (page, source, target) that were extracted.

    Chunks are in the order of their ids. A link joins each of the first LINKED nodes of a page with each of the other's: first are those that the earliest chunk
    names. Taxonomy edges and relations count where both ends are nodes; an extracted entity speaks through the first chunk of its page. Ends of an edge
    are in order; an edge of a node with itself is none. Counts are of distinct chunks and pages.
    """
    found = materialize(concepts(chunks), "concepts")
    pages = materialize(chunks.groupBy("page").agg(F.min("chunk").alias("first"), F.count_distinct("chunk").alias("n")), "pages")
    entity = lambda c: F.concat(F.lit("entity:"), concept_name(F.col(c)))
    extracted = entities.withColumn("label", F.trim("name")).withColumn("name", concept_name(F.col("name"))).filter("name <> ''").join(pages, "page")
    extracted = extracted.select(F.col("first").alias("chunk"), "page", F.concat(F.lit("entity:"), "name").alias("id"), F.lit("entity").alias("kind"), "label", "name", F.lit(EXTRACTED).alias("weight"), F.lit(TOP + 1).alias("rank"))
    said = found.union(extracted)
    mentions = materialize(said.select("chunk", "page", "id").distinct(), "mentions")
    order = F.struct("chunk", "rank", "label")
    main = said.groupBy("id").agg(F.min_by(F.struct("kind", "label", "name"), order).alias("x"), F.sum("weight").alias("weight"), F.min(F.struct("chunk", "rank")).alias("at"))
    counts = mentions.groupBy("id").agg(F.count_distinct("chunk").alias("chunks"), F.count_distinct("page").alias("pages"))
    others = said.select("id", "label").distinct().join(main.select("id", F.col("x.label").alias("_own")), "id").filter("label <> _own").groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("aliases"))
    nodes = materialize(main.join(counts, "id").join(others, "id", "left").select("id", "x.kind", "x.label", "x.name", quantise(F.col("weight"), 3).alias("weight"), "chunks", "pages", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "at"), "nodes")

    held = found.groupBy("chunk", "page").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pair = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    together = held.select("chunk", "page", F.inline(pair)).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))
    edges = together.select(*_edge(F.col("a"), F.col("b"), "cooccurs", TOGETHER), F.col("n").alias("times"), F.col("n").alias("chunks"), "pages", F.lit(False).alias("routing_only"))

    firsts = F.row_number().over(Window.partitionBy("page").orderBy("at"))
    heads = found.select("page", "id").distinct().join(nodes.select("id", "at"), "id").withColumn("k", firsts).filter(F.col("k") <= LINKED).groupBy("page").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads = materialize(heads, "heads")
    ends = links.select("from", "to").distinct().join(heads.select(F.col("page").alias("from"), F.col("ids").alias("left")), "from").join(heads.select(F.col("page").alias("to"), F.col("ids").alias("right")), "to")
    crossed = ends.select("from", "to", F.explode("left").alias("x"), "right").select("from", "to", "x", F.explode("right").alias("y")).filter("x <> y").select("from", "to", *_edge(F.col("x"), F.col("y"), "page-link", LINKED_PAGES))
    crossed = materialize(crossed, "crossed")
    by = ["a", "b", "kind"]
    spoke = crossed.select(*by, F.explode(F.array("from", "to")).alias("page")).distinct().join(pages.select("page", "n"), "page").groupBy(*by).agg(F.sum("n").alias("chunks"), F.count("*").alias("pages"))
    linked = crossed.groupBy(*by, "weight").agg(F.count("*").alias("times")).join(spoke, by).select(*by, "weight", "times", "chunks", "pages", F.lit(True).alias("routing_only"))

    known = nodes.select("id")
    concept = lambda c: F.concat(F.lit("concept:"), concept_name(F.col(c)))
    near = topics.select(*_edge(concept("from"), concept("to"), "topic-related", TOPICS)).filter("a <> b").join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    near = materialize(near.groupBy(*by, "weight").agg(F.count("*").alias("times")), "near")
    spoke = near.select(*by, F.explode(F.array("a", "b")).alias("id")).join(mentions, "id").groupBy(*by).agg(F.count_distinct("chunk").alias("chunks"), F.count_distinct("page").alias("pages"))
    topical = near.join(spoke, by).select(*by, "weight", "times", "chunks", "pages", F.lit(True).alias("routing_only"))

    told = relations.join(pages, "page").select("page", "first", *_edge(entity("source"), entity("target"), "llm-relation", RELATED)).filter("a <> b").join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    told = told.groupBy(*by, "weight").agg(F.count("*").alias("times"), F.count_distinct("first").alias("chunks"), F.count_distinct("page").alias("pages")).select(*by, "weight", "times", "chunks", "pages", F.lit(False).alias("routing_only"))
    every = edges.unionByName(linked).unionByName(topical).unionByName(told)
    every = every.select("a", "b", "kind", quantise(F.col("weight") * F.col("times"), 3).alias("weight"), "chunks", "pages", "routing_only")
    return Graph(nodes.drop("at"), materialize(every, "edges"), mentions)


def seeds(graph: Graph, query: list[str], lexical: DataFrame) -> DataFrame:
    """(node, score) of nodes that a question's tokens name, or whose chunks it hits (chunk, score): two points for each token, if there are two or a hit, and up to one for each hit."""
    support = graph.mentions.select("chunk", "id").distinct().join(lexical.select("chunk", F.least(F.col("score"), F.lit(1.0)).alias("s")), "chunk").groupBy("id").agg(F.sum(F.col("s").cast("decimal(18,6)")).cast("double").alias("support"))
    said = F.concat_ws(" ", "label", "name", F.array_join("aliases", " "))
    matched = F.size(F.array_intersect(tokens(said), F.array(*map(F.lit, dict.fromkeys(query))).cast("array<string>")))
    scored = graph.nodes.select("id", matched.alias("m")).join(support, "id", "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    named = F.when((F.col("m") >= 2) | (F.col("support") > 0), F.col("m") * 2.0).otherwise(0.0)
    return scored.select(F.col("id").alias("node"), quantise(named + F.col("support"), 6).alias("score")).filter("score > 0")


def chunk_boosts(graph: Graph, walked: DataFrame, lexical: DataFrame, most: float = 0.14) -> DataFrame:
    """(chunk, boost): what the nodes that a walk (node, boost) has reached give their chunks, but for those that the question hits itself; at most `most`."""
    hit = lexical.filter("score > 0").select("chunk").distinct()
    given = graph.mentions.select("chunk", F.col("id").alias("node")).distinct().join(F.broadcast(walked.select("node", "boost")), "node").join(hit, "chunk", "left_anti")
    return given.groupBy("chunk").agg(F.least(F.lit(most), F.sum(F.col("boost").cast("decimal(18,6)")).cast("double")).alias("boost")).filter("boost > 0")


def supplements(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, text): the values (page, place, key, value) that were extracted from a page, as lines of its first chunk. A page's values are a record, and so one row."""
    first = chunks.groupBy("page").agg(F.min("chunk").alias("chunk"))
    lines = records.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "key", F.coalesce("value", F.lit(""))).alias("line")))).alias("lines"))
    return lines.join(first, "page").select("chunk", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")).filter("text <> ''")
