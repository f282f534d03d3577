"""A BM25 index in segments, with postings in blocks that a search can leave out.

A segment is what one ``add`` wrote: documents, postings, statistics, and which older
documents it replaces. Statistics are signed counts, so those of the index are the sums
over its segments: a replaced document is subtracted by the segment that replaces it.
``marks`` says which segments count; its last row is read first and written last, so
a reader sees an index before or after a change and never half of one.

Postings of a term lie in blocks of documents whose numbers agree but for the last
``shift`` bits, chosen by term so that a block has about BLOCK of them. So the block of
a term that a document is in follows from its number, by an equal join. Each block
keeps ``best``, its highest term-frequency part, and with it a bound of what it can
add to a score. ``search`` finds a score that k documents reach, and reads then
only blocks that can lead to more:

1. Documents of the blocks with the highest bounds are scored; the k-th best is the threshold.
2. Terms whose highest bounds add up to less than it, the frequent ones, can't lift a
   document to it alone. Of the other terms a block is read if its bound, and the
   highest of all other terms, add up to the threshold.
3. What is found so, and can reach the threshold with the frequent terms, is looked
   up in the blocks of these that it is in.

The result is that of scoring every document.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from granary.functions.text import tokens
from granary.operators import text_many
from granary.operators.lexical import EPSILON, K1, B, counted_terms
from granary.runtime import shared_path
from granary.sources.files import exists

#: Postings that a block has about, and at most.
BLOCK, MOST = 128, 512
#: Blocks whose documents give the threshold; postings of a question up to which all of them are read.
SEEDS, FEW = 64, 100_000
#: Segments from which on ``add`` merges the smallest ones.
SEGMENTS = 8
#: Postings that a task sorts into blocks about: few enough for memory, however many there are.
SORTED = 500_000
#: Documents and questions that one task compares at once in ``search_many``; questions below which these aren't divided further for want of tasks.
DOCUMENTS, QUESTIONS, FEWEST = 16_384, 65_536, 1_024
#: Parts of a group of documents whose postings one task collects.
PACKS = 4
MARK = "version int, segments array<int>, n bigint, length bigint, mean_idf double"
TERMS = "term string, df bigint, own bigint, shift int, best double"
BLOCKS = "term string, range bigint, first bigint, last bigint, n bigint, best double, postings array<struct<row:bigint,tf:bigint,dl:bigint>>"
DEAD = "segment int, row bigint"
TOTALS = "n bigint, length bigint, own bigint, own_length bigint"


def part(tf: Column, dl: Column, avgdl: float) -> Column:
    """What a term's frequency adds, below one; the score is its sum, weighted."""
    return tf / (tf + K1 * (1 - B + B * dl / max(avgdl, 1e-9)))


@dataclass(frozen=True)
class Question:
    """What the index knows of a question: weights by term; by (segment, term) what a block's ``best`` is worth, the term's highest bound, and its shift."""

    weight: dict[str, float]
    worth: dict[tuple[int, str], float]
    bound: dict[tuple[int, str], float]
    shift: dict[tuple[int, str], int]
    postings: int

    def highest(self) -> dict[str, float]:
        """The most that each term can add to a score."""
        return {t: max((b for (_, u), b in self.bound.items() if u == t), default=0.0) for t in self.weight}


class TextIndex:
    """The index at ``path``, as its last mark says; ``TextIndex(...)`` again to see later ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        last = self._read("marks", MARK).orderBy(F.desc("version")).first()
        self.version, self.segments, self.n, self.length, self.mean_idf = (last.version, list(last.segments), last.n, last.length, last.mean_idf or 0.0) if last else (0, [], 0, 0, 0.0)
        self.avgdl = self.length / self.n if self.n else 0.0

    def _read(self, name: str, schema: str) -> DataFrame:
        there = exists(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).json(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _of(self, name: str, schema: StructType | str, segments: list[int] | None = None) -> DataFrame:
        """A table of the segments, with ``segment``."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        live = self.segments if segments is None else segments
        if not live:
            return self.spark.createDataFrame([], StructType([*schema.fields]).add("segment", IntegerType())) if "segment" not in schema.names else self.spark.createDataFrame([], schema)
        out = None
        for s in live:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/s{s}/{name}")
            one = one if "segment" in schema.names else one.withColumn("segment", F.lit(s))
            out = one if out is None else out.unionByName(one)
        return out

    # what the index holds

    @property
    def dead(self) -> DataFrame:
        """(segment, row) of documents that later segments replace or remove."""
        return self._of("dead", DEAD)

    def documents(self, segments: list[int] | None = None) -> DataFrame:
        """The documents that count, as they were given, with ``segment``, ``row`` and ``dl``."""
        if not self.segments:
            raise ValueError(f"{self.path} has no documents yet")
        schema = self.spark.read.parquet(f"{self.path}/s{self.segments[-1]}/documents").schema
        return self._of("documents", schema, segments).join(self.dead, ["segment", "row"], "left_anti")

    @property
    def terms(self) -> DataFrame:
        """(term, df) of all documents that count."""
        return self._of("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def blocks(self) -> DataFrame:
        return self._of("blocks", BLOCKS)

    @property
    def postings(self) -> DataFrame:
        """(segment, row, term, tf, dl) of the documents that count."""
        flat = self.blocks.select("segment", "term", F.explode("postings").alias("p")).select("segment", "p.row", "term", "p.tf", "p.dl")
        return flat.join(self.dead, ["segment", "row"], "left_anti")

    # changes

    def add(self, docs: DataFrame, order: tuple[str, ...] = ("id",), replace: bool = False, removed: DataFrame | None = None, id: str = "id", text: str = "text") -> TextIndex:
        """The index with ``docs``; with ``replace`` they take the place of older documents with their ids, and documents with the ids of ``removed`` go.

        All columns of ``docs`` are kept, and every ``add`` has the same ones. Rows with
        one id within ``docs`` are documents of their own. Documents are numbered in the order given.
        """
        number = self._next()
        rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"row": F.monotonically_increasing_id(), "dl": F.size(tokens(F.col(text))).cast("long")})
        rows.write.mode("overwrite").parquet(f"{self.path}/s{number}/documents")
        new = self.spark.read.schema(rows.schema).parquet(f"{self.path}/s{number}/documents")
        ids = [x for x in ((new.select(F.col(id).alias("id_")) if replace else None), (removed.select(F.col(id).alias("id_")) if removed is not None else None)) if x is not None]
        gone = None
        if ids and self.segments:
            gone_ids = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            gone = self.documents().join(gone_ids.distinct(), F.col(id) == F.col("id_"), "left_semi").select("segment", "row", "dl", F.col(text).alias("text_"))
            gone.select("segment", "row", "dl", "text_").write.mode("overwrite").parquet(f"{self.path}/s{number}/gone")
            gone = self.spark.read.schema(gone.schema).parquet(f"{self.path}/s{number}/gone")
        self._segment(number, new, text, gone)
        return self._marked([*self.segments, number]).merged(text=text)

    def merged(self, most: int | None = None, text: str = "text") -> TextIndex:
        """The index with at most ``most`` segments (SEGMENTS): while there are more, the smallest half is made one, without the documents that no longer count."""
        out, most = self, SEGMENTS if most is None else most
        while len(out.segments) > most:
            sizes = {r.segment: r.own for r in out._of("totals", TOTALS).collect()}
            small = sorted(sorted(out.segments, key=lambda s: (sizes[s], s))[: max(2, most // 2 + 1)])
            number = out._next()
            rows = out.documents(small).drop("row", "segment", "dl").withColumns({"row": F.monotonically_increasing_id(), "dl": F.size(tokens(F.col(text))).cast("long")})
            rows.write.mode("overwrite").parquet(f"{out.path}/s{number}/documents")
            out._segment(number, out.spark.read.schema(rows.schema).parquet(f"{out.path}/s{number}/documents"), text, None, small)
            out = out._marked([*[s for s in out.segments if s not in small], number])
        return out

    def vacuum(self) -> None:
        """Removes the files of segments that the last mark doesn't name; nothing may be reading them."""
        for s in set(range(1, self._next())) - set(self.segments):
            self._removed(f"{self.path}/s{s}")

    def _removed(self, path: str) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def _next(self) -> int:
        """A number above all that marks ever named. A change that was stopped has none, and is overwritten."""
        return (self._read("marks", MARK).agg(F.max(F.array_max("segments"))).first()[0] or 0) + 1

    def _segment(self, number: int, docs: DataFrame, text: str, gone: DataFrame | None, of: list[int] | None = None) -> None:
        """Writes all but the documents of a segment. ``of``: the segments that it takes the place of, whose counts it takes over."""
        folder = f"{self.path}/s{number}"
        own = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
        avgdl = own.l / own.n if own.n else 0.0
        lost = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first() if gone is not None else None
        n, length = own.n - (lost.n if lost else 0), own.l - (lost.l if lost else 0)
        if of is not None:
            n, length = self._of("totals", TOTALS, of).agg(F.sum("n"), F.sum("length")).first()
        self.spark.createDataFrame([(n, length, own.n, own.l)], TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
        dead = self._of("dead", DEAD, of).where(~F.col("segment").isin(of)) if of is not None else gone.select("segment", "row") if gone is not None else self.spark.createDataFrame([], DEAD)
        dead.write.mode("overwrite").parquet(f"{folder}/dead")
        found = docs.select("row", "dl", F.explode(counted_terms(F.col(text))).alias("t")).select("row", "dl", "t.term", "t.tf")
        found.write.mode("overwrite").parquet(f"{folder}/counted")  # texts are tokenized once for terms and blocks
        found = self.spark.read.schema(found.schema).parquet(f"{folder}/counted")
        added = part(F.col("tf"), F.col("dl"), avgdl).alias("part")
        terms = found.groupBy("term").agg(F.count("*").alias("own"), F.max(added).alias("best"))
        if of is not None:
            before = self._of("terms", TERMS, of).groupBy("term").agg(F.sum("df").alias("df"))
            terms = terms.join(before, "term", "full")
        elif gone is not None:
            less = gone.select(F.explode(F.array_distinct(tokens(F.col("text_")))).alias("term")).groupBy("term").agg(F.count("*").alias("less"))
            terms = terms.join(less, "term", "full").withColumn("df", F.coalesce("own", F.lit(0)) - F.coalesce("less", F.lit(0)))
        else:
            terms = terms.withColumn("df", F.col("own"))
        # documents are numbered densely within a task: 2 ** shift numbers hold about BLOCK of a term's postings
        shift = F.when(F.col("own") <= BLOCK, 62).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(F.lit(float(BLOCK * max(1, own.n))) / F.col("own"))))).cast("int")
        terms = terms.select("term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("own", F.lit(0)).alias("own"), F.coalesce(shift, F.lit(62)).alias("shift"), F.coalesce("best", F.lit(0.0)).alias("best"))
        terms.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        frequent = self._of("terms", TERMS, [number]).where(F.col("own") > BLOCK).select("term", "shift")
        # one shuffle of postings, for the join with the frequent terms and for the blocks, in parts that a task sorts in memory
        postings = self._of("terms", TERMS, [number]).agg(F.sum("own")).first()[0] or 0
        dealt = found.repartition(max(1, -(-postings // SORTED)), "term")
        ranged = dealt.select("*", added).join(frequent, "term", "left").withColumn("range", F.expr("shiftright(row, coalesce(shift, 62))"))
        # a range has at most 2 ** shift numbers and a term's postings, so about the square root of BLOCK times the documents; it is cut where it has more than MOST
        whole = ranged.groupBy("term", "range").agg(F.sort_array(F.collect_list(F.struct("row", "tf", "dl", "part"))).alias("p"))
        cuts = whole.select("term", "range", "p", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(p) - 1) div {MOST} as int)"))).alias("cut"))
        cuts = cuts.select("term", "range", F.when(F.size("p") <= MOST, F.col("p")).otherwise(F.slice("p", F.col("cut") * MOST + 1, MOST)).alias("p"))
        blocks = cuts.select(
            "term", "range", F.get("p", F.lit(0)).getField("row").alias("first"), F.element_at("p", -1).getField("row").alias("last"), F.size("p").cast("long").alias("n"),
            F.array_max(F.col("p.part")).alias("best"), F.arrays_zip(F.col("p.row").alias("row"), F.col("p.tf").alias("tf"), F.col("p.dl").alias("dl")).alias("postings"),
        )
        blocks.sortWithinPartitions("term", "range", "first").write.mode("overwrite").parquet(f"{folder}/blocks")
        self._removed(f"{folder}/counted")

    def _marked(self, segments: list[int]) -> TextIndex:
        """The index of these segments, once its mark is written."""
        n, length = self._of("totals", TOTALS, segments).agg(F.sum("n"), F.sum("length")).first()
        df = self._of("terms", TERMS, segments).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        mean = df.agg(F.avg(F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        self.spark.createDataFrame([(self.version + 1, segments, n, length, mean)], MARK).coalesce(1).write.mode("append").json(f"{self.path}/marks")
        return TextIndex(self.spark, self.path)

    # search

    def question(self, query: str) -> Question:
        """The statistics of a question's terms: a row a term and segment come to the driver."""
        times = Counter(self.spark.range(1).select(tokens(F.lit(query)).alias("w")).first().w)
        rows = self._of("terms", TERMS).where(F.col("term").isin(*times)).collect() if times and self.segments else []
        inflation = {r.segment: max(1.0, self.avgdl * r.own / max(r.own_length, 1e-9)) for r in self._of("totals", TOTALS).collect()} if rows else {}
        df = Counter()
        for r in rows:
            df[r.term] += r.df
        idf = self._idf({t: d for t, d in df.items() if d > 0})
        weight = {t: times[t] * x * (K1 + 1) for t, x in idf.items()}
        # a segment's best parts are those at its own mean length; at a longer one they grow by the ratio at most
        worth = {(r.segment, r.term): weight[r.term] * inflation[r.segment] for r in rows if r.own and r.term in weight}
        bound = {(r.segment, r.term): min(weight[r.term], worth[r.segment, r.term] * r.best) for r in rows if (r.segment, r.term) in worth}
        return Question(weight, worth, bound, {(r.segment, r.term): r.shift for r in rows if (r.segment, r.term) in worth}, sum(r.own for r in rows))

    def _idf(self, df: dict[str, int]) -> dict[str, float]:
        """As the scan computes it: by Spark's logarithm."""
        if not df:
            return {}
        rows = self.spark.createDataFrame(list(df.items()), "term string, df bigint").withColumn("idf", F.log(F.lit(float(self.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        return {r.term: r.idf if r.idf >= 0 else EPSILON * self.mean_idf for r in rows.collect()}

    def _added(self, q: Question, tf: Column, dl: Column) -> Column:
        weight = F.create_map(*[F.lit(x) for pair in q.weight.items() for x in pair])
        return F.element_at(weight, F.col("term")) * part(tf, dl, self.avgdl)

    @staticmethod
    def _constant(values: dict[tuple[int, str], float | int]) -> Column:
        """The value of a row's (segment, term)."""
        return F.element_at(F.create_map(*[F.lit(x) for (s, t), v in values.items() for x in (f"{s} {t}", v)]), F.concat_ws(" ", F.col("segment").cast("string"), "term"))

    def bounds(self, q: Question) -> DataFrame:
        """The blocks of a question's terms, with ``bound``: the most that one can add to a score."""
        rows = self.blocks.where(F.col("term").isin(*q.weight))
        return rows.withColumn("bound", F.least(F.col("best") * self._constant(q.worth), F.element_at(F.create_map(*[F.lit(x) for pair in q.weight.items() for x in pair]), F.col("term"))))

    def _summed(self, blocks: DataFrame, q: Question) -> DataFrame:
        flat = blocks.select("segment", "term", F.explode("postings").alias("p"))
        return flat.groupBy("segment", F.col("p.row").alias("row")).agg(F.sum(self._added(q, F.col("p.tf"), F.col("p.dl"))).alias("score")).join(self.dead, ["segment", "row"], "left_anti")

    def scores(self, query: str) -> DataFrame:
        """(segment, row, score) of every document that has a term of the question."""
        q = self.question(query)
        if not q.weight:
            return self.spark.createDataFrame([], "segment int, row bigint, score double")
        return self._summed(self.blocks.where(F.col("term").isin(*q.weight)), q)

    def threshold(self, q: Question, k: int) -> float:
        """A score that k documents reach: the k-th of what the SEEDS blocks with the highest bounds add to their documents. 0 if these are fewer."""
        seeds = self.bounds(q).select("segment", "term", "range", "first", "bound").orderBy(F.desc("bound"), "segment", "term", "range", "first").limit(SEEDS).collect()
        if not seeds:
            return 0.0
        keys = self.spark.createDataFrame([(r.segment, r.term, r.range, r.first) for r in seeds], "segment int, term string, range bigint, first bigint")
        blocks = self.blocks.where(F.col("term").isin(*{r.term for r in seeds}) & F.col("range").between(min(r.range for r in seeds), max(r.range for r in seeds)))
        best = self._summed(blocks.join(F.broadcast(keys), keys.columns, "left_semi"), q).orderBy(F.desc("score")).limit(k).select("score").collect()
        return min(r.score for r in best) if len(best) == k else 0.0

    def needed(self, q: Question, threshold: float) -> tuple[DataFrame, list[str]]:
        """The blocks that may lead to a score of ``threshold``, and the terms that alone can't: their blocks are looked up, not read."""
        highest, rest, looked_up = q.highest(), 0.0, []
        for t in sorted(highest, key=lambda t: (highest[t], t)):
            if rest + highest[t] >= threshold:
                break
            rest += highest[t]
            looked_up.append(t)
        total, wanted = sum(highest.values()), F.lit(False)
        for t in highest.keys() - set(looked_up):
            wanted = wanted | ((F.col("term") == t) & (F.col("bound") + (total - highest[t]) >= threshold))
        return self.bounds(q).where(wanted), looked_up

    def lookups(self, found: DataFrame, q: Question, terms: list[str]) -> DataFrame:
        """(segment, row, score): what ``terms`` add to the documents of ``found``, a written table, each from the block of the term that the document is in."""
        asked = found.select("segment", "row", F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
        asked = asked.withColumn("range", F.call_function("shiftright", F.col("row"), self._constant(q.shift))).where("range is not null")
        held = self.blocks.where(F.col("term").isin(*terms)).select("segment", "term", "range", "first", "last", "postings")
        both = asked.join(held, ["segment", "term", "range"]).where("row between first and last")
        own = F.filter("postings", lambda p: p.row == F.col("row"))
        both = both.withColumn("p", F.get(own, F.lit(0))).where("p is not null")
        return both.select("segment", "row", self._added(q, F.col("p.tf"), F.col("p.dl")).alias("score"))

    def best(self, query: str, k: int, digits: int | None = None) -> DataFrame:
        """(segment, row, score) of documents among which the k best are, with their whole scores."""
        q = self.question(query)
        if not q.weight:
            return self.scores(query)
        every = self.blocks.where(F.col("term").isin(*q.weight))
        if q.postings <= FEW or min(q.weight.values()) <= 0:
            return self._summed(every, q)
        slack = 1e-9 if digits is None else 10.0**-digits  # of sums in another order, and of rounded ones
        reached = self.threshold(q, k) - slack
        if reached <= 0:
            return self._summed(every, q)
        blocks, looked_up = self.needed(q, reached)
        found = self._summed(blocks, q)
        if not looked_up:
            return found
        rest = sum(h for t, h in q.highest().items() if t in looked_up)
        path = shared_path(self.spark, "found")
        found.where(F.col("score") + rest >= reached).write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        return found.unionByName(self.lookups(found, q, looked_up)).groupBy("segment", "row").agg(F.sum("score").alias("score"))

    def search(self, query: str, k: int, digits: int | None = None, id: str = "id") -> DataFrame:
        """The k best documents, those of a score above 0, with ``score`` and ``rank``; the smaller id first among equals. k + 1 numbers come to the driver."""
        found = self.best(query, k, digits)
        found = (found if digits is None else found.withColumn("score", F.round("score", digits))).where("score > 0")
        top = found.orderBy(F.desc("score"), "segment", "row").limit(k + 1).collect()
        if len(top) > k and top[k].score == top[k - 1].score:  # which of the documents of this score are among the k, their ids tell
            ids = self.documents().select("segment", "row", id).join(found.where(F.col("score") >= top[k].score), ["segment", "row"])
            top = ids.orderBy(F.desc("score"), id, "segment", "row").limit(k).select("segment", "row", "score").collect()
        best = self.spark.createDataFrame([(r.segment, r.row, r.score) for r in top[:k]], "segment int, row bigint, score double")
        docs = self.documents().where(F.col("segment").isin(*{r.segment for r in top}) & F.col("row").isin(*{r.row for r in top}))
        rows = docs.join(F.broadcast(best), ["segment", "row"]).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id, "segment", "row")))
        return rows.drop("segment", "row", "dl")

    # many questions

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _apart(self, n: int) -> list[int]:
        """n keys that ``repartition`` by n puts into partitions of their own, but for rare ones: a task each, none of which waits for another."""
        tried = self.spark.range(n * (n.bit_length() + 8)).select(F.col("id").cast("int").alias("key"))
        found = {r.place: r.key for r in tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("place")).agg(F.min("key").alias("key")).collect()}
        return [found.get(i, -1 - i) for i in range(n)]

    def search_many(self, questions: DataFrame, k: int, digits: int | None = None, question_id: str = "question_id", text: str = "text", id: str = "id") -> DataFrame:
        """(question_id, id, score, rank): for each row of ``questions`` the k best documents, as ``search`` finds them one by one.

        Groups of about DOCUMENTS documents meet groups of at most about QUESTIONS questions, a
        task for each pair of groups (see ``operators.text_many``). It keeps the k best of each
        question, so no table has a row for each (question, document) pair. A document's terms
        are collected once and travel as one row. Every shared term is added up: work is the
        product of questions and documents. Questions without a known term
        have no rows; question ids are distinct.
        """
        terms = self._kept(questions.select(F.col(question_id).alias("q"), F.explode(counted_terms(F.col(text))).alias("t")).select("q", "t.term", F.col("t.tf").alias("times")), "terms")
        known = self._of("terms", TERMS).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(F.lit(float(self.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weight = F.when(idf < 0, EPSILON * self.mean_idf).otherwise(idf) * (K1 + 1)
        known = self._kept(known.select("term", F.monotonically_increasing_id().alias("number"), weight.alias("weight")), "known")
        asked = terms.join(known, "term").groupBy("q").agg(F.collect_list(F.struct("number", (F.col("times") * F.col("weight")).alias("weight"))).alias("t"))
        asked = self._kept(asked.select("q", F.col("t.number").alias("numbers"), F.col("t.weight").alias("weights")), "asked")
        count, groups = asked.count(), max(1, -(-self.n // DOCUMENTS))
        # where groups are few, questions are divided further, so that all cores have tasks
        parts = max(1, -(-count // QUESTIONS), min(-(-self.spark.sparkContext.defaultParallelism // groups), -(-count // FEWEST)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asks = asked.withColumns({"qb": F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"), "db": every(groups)})
        place = F.element_at(F.lit(self._apart(groups * PACKS)), F.pmod(F.xxhash64("segment", "row"), F.lit(groups * PACKS)).cast("int") + 1).alias("b")
        # lengths are the documents': only numbers and frequencies are read and shuffled
        held = self.blocks.select("segment", "term", F.col("postings.row").alias("row"), F.col("postings.tf").alias("tf")).join(known.select("term", "number"), "term")
        flat = held.select("segment", "number", F.explode(F.arrays_zip("row", "tf")).alias("p")).select("segment", "p.row", "number", F.col("p.tf").cast("int").alias("tf"))
        ids = self.documents().select("segment", "row", F.col(id).alias("id"), "dl")
        kind = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *ids.schema.fields]}
        rows = f"segment int, row bigint, id {kind['id']}, dl bigint, numbers array<bigint>, tfs array<int>"
        flat, named = (x.select("*", place).repartition(groups * PACKS, "b").groupBy("b") for x in (flat, ids))
        whole = flat.cogroup(named).applyInPandas(lambda postings, docs: text_many.packed(postings, docs).drop(columns="b"), rows)
        held = whole.withColumns({"db": F.pmod(F.xxhash64("segment", "row"), F.lit(groups)).cast("int"), "qb": every(parts)})
        slack = 1e-9 if digits is None else 2 * 10.0**-digits  # of sums in another order, and of rounded ones
        avgdl, key = self.avgdl, F.element_at(F.lit(self._apart(groups * parts)), F.col("db") * parts + F.col("qb") + 1).alias("task")

        def best(own: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            return text_many.best(own, members, k, slack, lambda tf, dl: part(tf, dl, avgdl))

        # by number of tasks, so that Spark doesn't put small ones together
        asks, held = (x.select("*", key).repartition(groups * parts, "task").groupBy("task") for x in (asks, held))
        whole = asks.cogroup(held).applyInPandas(best, f"q {kind['q']}, segment int, row bigint, score double")
        whole = (whole if digits is None else whole.withColumn("score", F.round("score", digits))).where("score > 0")
        # ids join what each question's k best scores leave, equal ones included
        whole = whole.withColumn("nth", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") <= k)
        named = whole.join(ids, ["segment", "row"])
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "segment", "row"))
        return named.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("question_id"), "id", "score", "rank")
