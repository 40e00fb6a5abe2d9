"""The dataset registry: retrieval collections, their expected sizes and published results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Forums of the aggregate collection.
FORUMS = "android english gaming gis mathematica physics programmers stats tex unix webmasters wordpress".split()
# Name, tier, documents, queries, published nDCG@10 of BM25.
PUBLISHED = [
    ("scifact", 1, 5183, 300, 0.665),
    ("nfcorpus", 1, 3633, 323, 0.325),
    ("fiqa", 1, 57638, 648, 0.236),
    ("arguana", 1, 8674, 1406, 0.472),
    ("scidocs", 1, 25657, 1000, 0.158),
    ("trec-covid", 2, 171332, 50, 0.656),
    ("webis-touche2020", 2, 382545, 49, 0.367),
    ("cqadupstack", 2, None, None, 0.299),
    ("quora", 2, 522931, 10000, 0.789),
    ("nq", 3, 2681468, 3452, 0.329),
    ("hotpotqa", 3, 5233329, 7405, 0.603),
    ("fever", 3, 5416568, 6666, 0.753),
    ("climate-fever", 3, 5416593, 1535, 0.213),
    ("dbpedia-entity", 3, 4635922, 400, 0.313),
    ("msmarco", 3, 8841823, 6980, 0.228),
]
IGNORE_IDENTICAL = {"arguana", "quora"}


@dataclass(frozen=True)
class Dataset:
    id: str
    family: str
    tier: int
    index: str
    data_dir: str
    split: str = "test"
    relevance_mode: str = "linear"
    ignore_identical: bool = False
    aggregate_of: tuple[str, ...] = ()
    part_of: str | None = None
    documents: int | None = None
    queries: int | None = None
    published: float | None = None


@dataclass(frozen=True)
class Registry:
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def get(self, dataset_id: str) -> Dataset:
        if dataset_id not in self.datasets:
            raise ValueError(f"Unknown dataset {dataset_id}; known datasets: {', '.join(self.datasets)}")
        return self.datasets[dataset_id]

    def list(self) -> list[Dataset]:
        return list(self.datasets.values())

    def index_of(self, dataset_id: str, *, override: str | None = None, configured: dict[str, str] | None = None) -> str:
        """An explicit name first, then a configured one, then the dataset's own."""
        return override or (configured or {}).get(dataset_id) or self.get(dataset_id).index

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(d.id, d.family, d.tier, d.index, d.relevance_mode, d.ignore_identical, d.documents, d.queries, d.published) for d in self.list()]
        return spark.createDataFrame(rows, "dataset string, family string, tier int, index string, relevance_mode string, ignore_identical boolean, documents long, queries long, published double")


def _own(name: str, tier: int, **more) -> Dataset:
    return Dataset(f"beir/{name}", "beir", tier, f"beir-{name.replace('/', '-')}-v0", f"data/beir/{name}", **more)


def _all() -> dict[str, Dataset]:
    rows = [Dataset("cranfield", "cranfield", 0, "cranfield-v0", "data/cranfield", split="all", relevance_mode="graded", documents=1400, queries=225)]
    for name, tier, documents, queries, published in PUBLISHED:
        parts = tuple(f"beir/{name}/{f}" for f in FORUMS) if name == "cqadupstack" else ()
        rows.append(_own(name, tier, split="dev" if name == "msmarco" else "test", ignore_identical=name in IGNORE_IDENTICAL, aggregate_of=parts, documents=documents, queries=queries, published=published))
        rows += [_own(f"{name}/{f}", tier, part_of=f"beir/{name}") for f in (FORUMS if parts else ())]
    return {d.id: d for d in rows}


REGISTRY = Registry(_all())
