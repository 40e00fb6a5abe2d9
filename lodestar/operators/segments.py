"""A stored index: segments that never change, named by a manifest.

A load writes a segment (documents, and packed postings, by shard and sorted by term in it), a removal or a replacement writes a tombstone (the places that are dead, and what
they take from the statistics), and then a new version of the manifest names what counts. Its file is made once under its number, so of two writers one fails, and a
writer that is killed leaves the last version as it was. Nothing is shuffled to make a segment; a search tells the scan its terms, and pages that can't hold them are skipped. Statistics are summed over segments and tombstones, so scores are those of an index made
at once from the documents that are left. ``merge`` rewrites small segments as one and drops what is dead; ``vacuum`` deletes what no version names.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import blocks, english
from lodestar.operators.index import Analyzer, query_terms, small
from lodestar.operators.store import Folder, materialized

#: Terms that a scan is told by name; more are joined.
NAMED_TERMS = 10_000
#: Queries that one search answers; their terms' weights go to all tasks.
BLOCK_QUERIES = 2_000
_SMALL_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.row.count.limit": "1024", "parquet.writer.version": "v2", "compression": "zstd"}
#: Analyzers whose last step, or all of it, the tasks that pack the tokens take themselves: what comes before it, and that step on an Arrow column.
IN_PYTHON = {tx.tokens: (lambda c: c.cast("string"), tx.arrow_tokens), english.analyzed: (english.words, english.stem_lists)}
_HEAD = ["shard", "dataset", "field", "term", "n"]


class ConflictError(RuntimeError):
    """Another writer made the next version first."""


def _among(name: str, terms: list[str]) -> Column:
    """``name IN (...)``, told as text: a literal a call would take longer than the scan."""
    quoted = (t.replace("\\", "\\\\").replace("'", "\\'") for t in terms)
    return F.expr(f"{name} IN ({', '.join(f"'{t}'" for t in quoted)})") if terms else F.lit(False)


class Index:
    """The version of a stored index that was newest when it was opened; ``refresh`` opens the newest."""

    def __init__(self, spark: SparkSession, path: str, version: int, told: dict, analyzer: Analyzer) -> None:
        self.spark, self.path, self.version, self.told, self.analyzer = spark, path, version, told, analyzer
        self.field_names: list[str] = told["fields"]

    # --- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, fields: list[str], *, analyzer: Analyzer = tx.tokens) -> Index:
        """The index at ``path``, made empty if there is none; one with other fields is an error."""
        try:
            found = cls.open(spark, path, analyzer=analyzer)
        except FileNotFoundError:
            return cls._written(spark, path, 1, {"fields": list(fields), "segments": [], "tombstones": []}, analyzer)
        if found.field_names != list(fields):
            raise ValueError(f"the index has the fields {', '.join(found.field_names)}")
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, analyzer: Analyzer = tx.tokens) -> Index:
        folder = Folder(spark, f"{path}/manifest")
        for name in sorted(folder.names(), reverse=True):
            try:
                return cls(spark, path, int(name.split(".")[0]), json.loads(folder.text(name)), analyzer)
            except ValueError:
                continue  # a writer was killed while it made this version
        raise FileNotFoundError(f"no index at {path}")

    @classmethod
    def _written(cls, spark: SparkSession, path: str, version: int, told: dict, analyzer: Analyzer) -> Index:
        folder = Folder(spark, f"{path}/manifest")
        while f"{version:09d}.json" in folder.names() and not _sound(folder, f"{version:09d}.json"):
            version += 1  # left by a killed writer
        if not folder.make(f"{version:09d}.json", json.dumps(told)):
            raise ConflictError(f"version {version} of {path} was made by another writer")
        return cls(spark, path, version, told, analyzer)

    def _next(self, **changed) -> Index:
        return self._written(self.spark, self.path, self.version + 1, self.told | changed, self.analyzer)

    def refresh(self) -> Index:
        return self.open(self.spark, self.path, analyzer=self.analyzer)

    def drop(self) -> None:
        Folder(self.spark, self.path).delete()

    def vacuum(self) -> list[str]:
        """Deletes segments, tombstones and older manifests that this version doesn't name; returns what was deleted. Nothing else may be writing or reading."""
        named = {f"segments/{s['id']}" for s in self.told["segments"]} | {f"tombstones/{t['id']}" for t in self.told["tombstones"]} | {f"manifest/{self.version:09d}.json"}
        gone = []
        for part in ("segments", "tombstones", "manifest"):
            folder = Folder(self.spark, f"{self.path}/{part}")
            for name in folder.names():
                if f"{part}/{name}" not in named:
                    folder.delete(name)
                    gone.append(f"{part}/{name}")
        return sorted(gone)

    # --- writing

    def load(self, docs: DataFrame, *, replace: bool = False, batch: str | None = None, store: bool = True) -> Index:
        """The next version, with ``docs`` (id, a column a field, further columns) as a segment; with ``replace``, documents of the same ids go.

        ``batch`` names a load: one that the index has already isn't made again. Ids of one load should differ. Null ids and null fields are as they are, empty. Without
        ``store`` the documents themselves aren't kept; such an index is searched only: nothing of it can be removed, replaced or merged.
        """
        if batch is not None and any(s["batch"] == batch for s in self.told["segments"] + self.told.get("merged", [])):
            return self
        segment = self._segment(docs, batch, store)
        told = self._without(self._placed([segment]).select("id")) if replace and self.told["segments"] else self.told
        return self._next(segments=[*self.told["segments"], segment], tombstones=told["tombstones"])

    def _segment(self, docs: DataFrame, batch: str | None, store: bool = True) -> dict:
        name = f"{uuid.uuid4()}"
        at = f"{self.path}/segments/{name}"
        own = docs if "dataset" in docs.columns else docs.withColumn("dataset", F.lit(None).cast("string"))
        if store:
            own.write.option("compression", "zstd").parquet(f"{at}/stored")
            own = self.spark.read.schema(own.schema).parquet(f"{at}/stored")  # so that all parts of the segment are of the same rows
        before, tokenizer = IN_PYTHON.get(self.analyzer, (self.analyzer, None))
        texts = [before(F.col(f)).alias(f) for f in self.field_names]
        tokens = own.select(F.col("id").cast("string").alias("id"), F.col("dataset").cast("string").alias("dataset"), *texts)
        blocks.packed(tokens, self.field_names, tokenizer).write.options(**_SMALL_ROWS).parquet(f"{at}/packed")  # no shuffle: a task packs its own documents
        packed = self.spark.read.schema(blocks.ROW).parquet(f"{at}/packed")
        told = packed.groupBy("field", F.col("term").isNull().alias("whole")).agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # two rows a field
        docs = sum(r["n"] for r in told if r["field"] is None)
        fields = {r["field"]: [r["n"], r["words"]] for r in told if r["whole"] and r["field"] is not None}
        return {"id": name, "docs": docs, "postings": sum(r["n"] for r in told if not r["whole"]), "batch": batch, "fields": fields, "stored": store}

    def _without(self, ids: DataFrame) -> dict:
        """What the manifest says without the documents of these ids (null ids stay)."""
        dead = self._docs().join(ids.select("id").where("id is not null").distinct(), "id", "left_semi")
        name = f"{uuid.uuid4()}"
        at = f"{self.path}/tombstones/{name}"
        dead.select("segment", "shard", "place", "id").write.parquet(f"{at}/docs")
        dead = self.spark.read.schema("segment string, shard string, place int, id string").parquet(f"{at}/docs")
        n = dead.count()
        if not n:
            return self.told
        packed = dead.groupBy("segment", "shard").agg(F.array_sort(F.collect_set("place")).alias("places"))  # at most a shard's documents
        packed.write.parquet(f"{at}/places")
        texts = self.stored().join(dead.select("segment", "id"), ["segment", "id"], "left_semi")
        tokens = texts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), self.analyzer(F.col(f)).alias("tokens")) for f in self.field_names])).alias("f")).select("f.field", "f.tokens")
        fields = tokens.where(F.size("tokens") > 0).groupBy("field").agg(F.count("*").alias("n"), F.sum(F.size("tokens").cast("long")).alias("words")).collect()  # a row a field
        tokens.select("field", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("df")).repartition("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        return self.told | {"tombstones": [*self.told["tombstones"], {"id": name, "docs": n, "fields": {r["field"]: [r["n"], r["words"]] for r in fields}}]}

    def remove(self, ids: DataFrame) -> Index:
        """The next version, without the documents of ``ids`` (id)."""
        return self._next(tombstones=self._without(ids)["tombstones"])

    def merge(self, most: int = 1) -> Index:
        """The next version, with at most ``most`` segments: the smallest become one, and no dead document is left in any."""
        old = sorted(self.told["segments"], key=lambda s: -s["docs"])
        if len(old) <= most and not self.told["tombstones"]:
            return self
        kept = [] if self.told["tombstones"] else old[: most - 1]  # a dead document may be in any segment
        gone = [s for s in old if s not in kept]
        docs = self.stored().where(F.col("segment").isin([s["id"] for s in gone])).drop("segment")
        segment = self._segment(docs, None)
        return self._next(segments=[*kept, *[segment][: bool(segment["docs"])]], tombstones=[], merged=[*self.told.get("merged", []), *[{"batch": s["batch"]} for s in gone if s["batch"]]])

    # --- reading

    def _read(self, segments: list[dict], part: str) -> DataFrame | None:
        found = None
        for s in segments:
            df = self.spark.read.parquet(f"{self.path}/segments/{s['id']}/{part}").withColumn("segment", F.lit(s["id"]))
            found = df if found is None else found.unionByName(df, allowMissingColumns=True)
        return found

    def _dead(self, part: str) -> DataFrame | None:
        found = None
        for t in self.told["tombstones"]:
            df = self.spark.read.parquet(f"{self.path}/tombstones/{t['id']}/{part}")
            found = df if found is None else found.unionByName(df)
        return found

    def _docs(self) -> DataFrame:
        """(segment, shard, dataset, place, id) of documents that are alive."""
        every = self._placed()
        if every is None:
            return self.spark.createDataFrame([], "segment string, shard string, dataset string, place int, id string")
        dead = self._dead("docs")
        return every if dead is None else every.join(small(dead.select("segment", "shard", "place")), ["segment", "shard", "place"], "left_anti")

    def _ids(self, segments: list[dict] | None = None) -> DataFrame | None:
        """(segment, shard, dataset, n, ids): a row a shard."""
        packed = self._read(self.told["segments"] if segments is None else segments, "packed")
        return None if packed is None else packed.where("term is null and field is null").select("segment", "shard", "dataset", "n", "ids")

    def _placed(self, segments: list[dict] | None = None) -> DataFrame | None:
        ids = self._ids(segments)
        return None if ids is None else ids.select("segment", "shard", "dataset", F.posexplode("ids").alias("place", "id"))

    def stored(self) -> DataFrame:
        """The documents that are alive as they were loaded, with their segment."""
        if not all(s["stored"] for s in self.told["segments"]):
            raise ValueError("this index doesn't keep its documents")
        every = self._read(self.told["segments"], "stored")
        if every is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ("segment", "id", "dataset", *self.field_names)))
        dead = self._dead("docs")
        return every if dead is None else every.join(small(dead.select("segment", "id")), ["segment", "id"], "left_anti")

    def count(self, dataset: str | None = None) -> int:
        if dataset is None:
            return sum(s["docs"] for s in self.told["segments"]) - sum(t["docs"] for t in self.told["tombstones"])
        return self._docs().where(F.col("dataset") == dataset).count()

    def statistics(self) -> dict[str, tuple[int, float]]:
        """By field: how many documents that are alive have it, and their mean length."""
        n, words = dict.fromkeys(self.field_names, 0), dict.fromkeys(self.field_names, 0)
        for sign, parts in ((1, self.told["segments"]), (-1, self.told["tombstones"])):
            for part in parts:
                for f, (some, of) in part["fields"].items():
                    n[f], words[f] = n[f] + sign * some, words[f] + sign * of
        return {f: (n[f], words[f] / n[f]) for f in self.field_names if n[f] > 0}

    @property
    def fields(self) -> DataFrame:
        """(field, n_docs, avg_len) of what is alive."""
        return self.spark.createDataFrame([(f, n, mean) for f, (n, mean) in self.statistics().items()], "field string, n_docs long, avg_len double")

    def _named(self, terms: DataFrame) -> list[str] | None:
        """The distinct terms, if they are few enough to tell a scan."""
        rows = terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()
        return [r["term"] for r in rows] if len(rows) <= NAMED_TERMS else None

    def rows(self, terms: DataFrame, columns: list[str], *, dataset: str | None = None, named: list[str] | None = None) -> DataFrame | None:
        """Packed rows of ``terms``: a scan that is told the terms, or a join where they are too many to name."""
        found = None
        for s in self.told["segments"]:
            df = self.spark.read.schema(blocks.ROW).parquet(f"{self.path}/segments/{s['id']}/packed")
            df = df.where(_among("term", named)) if named is not None else df.join(small(terms.select("term").distinct()), "term", "left_semi")
            df = df if dataset is None else df.where(F.col("dataset") == dataset)
            df = df.select(*columns, F.lit(s["id"]).alias("segment"))
            found = df if found is None else found.unionByName(df)
        return found

    def _places(self, columns: list[str]) -> DataFrame | None:
        """Dead places as rows without a term."""
        dead = self._dead("places")
        if dead is None:
            return None
        kinds = {c.rsplit(" ", 1)[0]: c.rsplit(" ", 1)[1] for c in blocks.ROW.split(", ")}
        two = lambda p: F.concat(F.substring(F.lpad(F.hex(p), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(p), 4, "0"), 1, 2))
        packed = F.unhex(F.array_join(F.transform("places", two), ""))  # as the blocks have them, two bytes a place
        own = {"segment": F.col("segment"), "shard": F.col("shard"), "places": packed}
        return dead.select(*[own.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in [*columns, "segment"]])

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(field, term, df) of the whole index: a filter doesn't change what a term is worth."""
        return self._frequencies(terms, self._named(terms))

    def _frequencies(self, terms: DataFrame, named: list[str] | None) -> DataFrame:
        found = self.rows(terms, ["field", "term", "n"], named=named)
        if found is None:
            return self.spark.createDataFrame([], "field string, term string, df long")
        found, dead = found.drop("segment"), self._dead("terms")
        if dead is not None:
            dead = dead.where(_among("term", named)) if named is not None else dead.join(small(terms.select("term").distinct()), "term", "left_semi")
            found = found.unionByName(dead.select("field", "term", (-F.col("df")).alias("n")))
        return found.groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")

    def _shard(self) -> Column:
        """A shard's name in the whole index, by its segment's place in the manifest."""
        place = F.create_map(*[F.lit(x) for k, s in enumerate(self.told["segments"]) for x in (s["id"], str(k))])
        return F.concat_ws("/", place[F.col("segment")], "shard")

    def _by_shard(self, found: DataFrame, columns: list[str], more: DataFrame | None = None) -> DataFrame:
        """Rows dealt out by shard, and ``more`` of them that have its name: all of a shard in one task, those without a term first."""
        dead = self._places(columns)
        every = found if dead is None else found.unionByName(dead)
        every = every.withColumn("shard", self._shard()).drop("segment")
        every = every if more is None else every.unionByName(more, allowMissingColumns=True)
        return every.repartition("shard").sortWithinPartitions(F.col("shard"), F.col("term").asc_nulls_first())

    def postings(self, terms: DataFrame, dataset: str | None = None, positions: bool = False) -> DataFrame:
        """(field, term, id, dl, tf), and positions if asked for, of ``terms`` (term), one by one."""
        packed = [*_HEAD, "places", "counts", "lengths", *["positions"][:positions]]
        found, columns = self.rows(terms, packed, dataset=dataset, named=self._named(terms)), [*packed, "ids"]
        if found is None:
            return self.spark.createDataFrame([], "field string, term string, id string, dl int, tf long" + (", positions array<int>" if positions else ""))
        ids = self._ids()
        ids = ids if dataset is None else ids.where(F.col("dataset") == dataset)
        every = found.unionByName(ids, allowMissingColumns=True).select(*columns, "segment")
        return blocks.unpacked(self._by_shard(every, columns), positions)

    def holding(self, terms: DataFrame, fields: list[str]) -> DataFrame:
        """(query_id, field, term, id, dl, positions, shard, place) of the documents that have all of a query's ``terms`` (query_id, term) in one of ``fields``.

        Places are intersected by shard first, without positions. Then the tasks that read positions cut out those of the documents found, and only these are dealt out.
        """
        kind = terms.schema["query_id"].dataType.simpleString()
        found = self.spark.createDataFrame([], f"query_id {kind}, field string, term string, id string, dl int, positions array<int>, shard string, place int")
        if not self.told["segments"]:
            return found
        docs = self._placed().select(self._shard().alias("shard"), "place", "id")
        for ids, asked in _query_blocks(terms.select("query_id", "term", F.lit(1).alias("qtf"))):
            own = [[t for t, _ in words] for words in asked]
            every = sorted({t for words in own for t in words})
            named = every if len(every) <= NAMED_TERMS else None
            wanted = self.spark.createDataFrame([(t,) for t in every], "term string")
            within = lambda columns: self.rows(wanted, columns, named=named).where(F.col("field").isin(fields))  # noqa: B023, E731
            columns = ["shard", "field", "term", "places"]
            places = materialized(blocks.holding(self._by_shard(within(columns), columns), own, fields))  # narrow, and read three times
            words = self.spark.createDataFrame([(q, i, t) for q, (i, terms_) in enumerate(zip(ids, own, strict=True)) for t in terms_], f"query int, query_id {kind}, term string")
            each = places.join(F.broadcast(words), "query")  # at most BLOCK_QUERIES queries
            cuts = small(each.groupBy("shard", "field", "term").agg(F.collect_set("place").alias("wanted")))
            posted = blocks.cut(within([*columns, "counts", "lengths", "positions"]).withColumn("shard", self._shard()).join(cuts, ["shard", "field", "term"]))
            known = docs.join(small(places.select("shard", "place").distinct()), ["shard", "place"])
            met = posted.join(small(known), ["shard", "place"]).join(each, ["shard", "field", "term", "place"])
            found = found.unionByName(met.select("query_id", "field", "term", "id", "dl", "positions", "shard", "place"))
        return found

    def top(self, queries: DataFrame, k: int, boosts: dict[str, float], *, tie: float | None = None, k1: float = 1.2, b: float = 0.75, factor: float = 1.0, dataset: str | None = None, analyzer: Analyzer | None = None) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best documents of each query (query_id, query) by BM25, blocks that can't get in left out.

        Fields count by their best, with ``tie`` times the others, or by their sum if ``tie`` is None. Scores are rounded to six digits before they order; ties go by id.
        """
        found, _ = self._searched(query_terms(queries, analyzer or self.analyzer), k, blocks.Combine(boosts, tie), (k1, b, factor), dataset)
        return found

    def at_least(self, queries: DataFrame, k: int, boosts: dict[str, float], share: float, *, profile: tuple = (1.2, 0.75, 1.0), analyzer: Analyzer | None = None) -> DataFrame:
        """``top`` by ``blocks.AtLeast``: as ``retrieval.at_least``, with no row a match."""
        return self._searched(query_terms(queries, analyzer or self.analyzer), k, blocks.AtLeast(boosts, share), profile, None)[0]

    def cross_fields(self, queries: DataFrame, k: int, boosts: dict[str, float], *, profile: tuple = (1.2, 0.75, 1.0), analyzer: Analyzer | None = None) -> DataFrame:
        """``top`` by ``blocks.CrossFields``: as ``retrieval.cross_fields``, with no row a match."""
        return self._searched(query_terms(queries, analyzer or self.analyzer), k, blocks.CrossFields(boosts), profile, None)[0]

    def rescue(self, queries: DataFrame, k: int, boosts: dict[str, float], phrases: DataFrame, *, profile: tuple = (1.2, 0.75, 1.0), dataset: str | None = None, analyzer: Analyzer | None = None) -> DataFrame:
        """``top`` by ``blocks.Rescue``: as ``retrieval.rescue``; the scores of ``phrases`` (query_id, id, score; shard and place are looked up if they lack them) meet the others where their shard is scored."""
        if "place" not in phrases.columns and self.told["segments"]:
            phrases = self._docs().select("id", self._shard().alias("shard"), "place").join(phrases, "id")
        return self._searched(query_terms(queries, analyzer or self.analyzer), k, blocks.Rescue(boosts), profile, dataset, phrases)[0]

    def expanded(self, queries: DataFrame, more: DataFrame, k: int, boosts: dict[str, float], more_boosts: dict[str, float], *, profile: tuple = (1.2, 0.75, 1.0), dataset: str | None = None, analyzer: Analyzer | None = None) -> DataFrame:
        """``top`` by ``blocks.Expanded``, with ``more`` (query_id, query) for the further terms: as ``retrieval.expanded_field_sum``, with no row a match."""
        parts = [query_terms(q, analyzer or self.analyzer).withColumn("part", F.lit(p)) for p, q in enumerate((queries, more))]
        return self._searched(parts[0].unionByName(parts[1]), k, blocks.Expanded(boosts, more_boosts), profile, dataset)[0]

    def windows(self, queries: DataFrame, k: int, boosts: dict[str, float], *, tie: float | None = None, dataset: str | None = None) -> DataFrame:
        """(query_id, seen, read): windows of documents that have some term of a query, and those of them that a search scores. It depends on how shards fall to tasks."""
        return self._searched(query_terms(queries, self.analyzer), k, blocks.Combine(boosts, tie), (1.2, 0.75, 1.0), dataset)[1]

    def _searched(self, asked_terms: DataFrame, k: int, combine, profile: tuple, dataset: str | None, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        kind = asked_terms.schema["query_id"].dataType.simpleString()
        results, told = self.spark.createDataFrame([], f"query_id {kind}, id string, score double, rank int"), self.spark.createDataFrame([], f"query_id {kind}, seen long, read long")
        if not self.told["segments"]:
            return results, told
        statistics = self.statistics()
        first = True
        for ids, asked in _query_blocks(asked_terms):
            named = sorted({t[0] for own in asked for t in own})
            terms = self.spark.createDataFrame([(t,) for t in named], "term string")
            named = named if len(named) <= NAMED_TERMS else None
            fields = [f for f in combine.boosts if f in statistics]
            df = self._frequencies(terms, named).where(F.col("field").isin(list(combine.boosts))).collect()  # a row a term and field
            idf = {(r["field"], r["term"]): math.log(1.0 + (statistics[r["field"]][0] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in df if r["field"] in statistics}
            model = blocks.Model(*profile, idf, {f: statistics[f][1] for f in fields}, _blended(df, statistics) if isinstance(combine, blocks.CrossFields | blocks.Rescue) else {})
            bounds = ["blocks", "edge_blocks", "edge_counts", "edge_lengths"] if isinstance(combine, blocks.Combine) else []
            columns = ["shard", "field", "term", "places", "counts", "lengths", *bounds]
            rows = self.rows(terms, columns, dataset=dataset, named=named).where(F.col("field").isin(fields))
            names = F.broadcast(self.spark.createDataFrame(list(enumerate(ids)), f"query int, query_id {kind}"))  # at most BLOCK_QUERIES rows
            own = None if given is None else given.join(names, "query_id").groupBy("shard", "query").agg(F.collect_list("place").alias("at"), F.collect_list("score").alias("points"))  # at most a shard's documents
            out = blocks.searched(self._by_shard(rows, columns, own), asked, model, combine, k)
            part, seen = self._named_top(out, k).join(names, "query"), out.where("seen is not null").groupBy("query").agg(F.sum("seen").alias("seen"), F.sum("read").alias("read")).join(names, "query")
            part, seen = part.select("query_id", "id", "score", "rank"), seen.select("query_id", "seen", "read")
            results, told = (part, seen) if first else (results.unionAll(part), told.unionAll(seen))
            first = False
        return results, told

    def _named_top(self, out: DataFrame, k: int) -> DataFrame:
        """(query, id, score, rank): ids are looked up for the best scores only, with all that are equal to the last."""
        near = out.where("place is not null").withColumn("r", F.rank().over(Window.partitionBy("query").orderBy(F.col("score").desc()))).where(F.col("r") <= k)
        docs = self._placed().select(self._shard().alias("shard"), "place", "id")
        named = docs.join(near.select("query", "shard", "place", "score"), ["shard", "place"])
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "score", "rank")


def _sound(folder: Folder, name: str) -> bool:
    try:
        json.loads(folder.text(name))
    except ValueError:
        return False
    return True


def _blended(frequencies: list, statistics: dict[str, tuple[int, float]]) -> dict[tuple[str, str], float]:
    """(field, term) to the idf of the term's largest frequency in any field, of which a field has no more than documents."""
    most: dict[str, int] = {}
    for r in frequencies:
        most[r["term"]] = max(most.get(r["term"], 0), r["df"])
    least = {(r["field"], r["term"]): (statistics[r["field"]][0], min(most[r["term"]], statistics[r["field"]][0])) for r in frequencies if r["field"] in statistics}
    return {key: math.log(1.0 + (n - df + 0.5) / (df + 0.5)) for key, (n, df) in least.items()}


def _query_blocks(terms: DataFrame):
    """(ids, (term, count) of each query, and its part where terms have one) of blocks of queries, streamed."""
    ids, asked = [], []
    columns = ["term", "qtf", *["part"][: int("part" in terms.columns)]]
    for row in terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("terms")).toLocalIterator():
        if len(ids) == BLOCK_QUERIES:
            yield ids, asked
            ids, asked = [], []
        ids.append(row["query_id"])
        asked.append([tuple(t) for t in row["terms"]])
    if ids:
        yield ids, asked
