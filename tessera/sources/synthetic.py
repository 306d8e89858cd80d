"""A seeded corpus as a data source: `spark.read.format("tessera_corpus").option("documents", n).load()`.

Partitions are ranges of ids, so a read scales out, and every document depends on the seed and its id alone. Filters on the
id prune ranges before anything is generated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessera.functions.rng import MASK, SplitMix64

SYLLABLES = "ba be bo da do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va vo".split()
FACTS = ("founded in", "led by", "holds", "lies near")


@dataclass
class IdRange(InputPartition):
    low: int
    high: int


def name(random: SplitMix64) -> str:
    return "".join(SYLLABLES[random.below(len(SYLLABLES))] for _ in range(2 + random.below(2))).capitalize()


def document(seed: int, number: int, nodes: int) -> tuple:
    """A document of 2 to 4 paragraphs that each state a fact about its subject; its node is its number's turn."""
    random = SplitMix64.derived(seed, number & MASK)
    subject = name(random)
    paragraphs = [f"{subject} {FACTS[k]} {name(random) if k % 2 else 1000 + random.below(1000)}. " + " ".join(name(random).lower() for _ in range(8 + random.below(8))) + "." for k in range(2 + random.below(3))]
    return number, f"node{number % nodes}", subject, "\n\n".join(paragraphs), len(paragraphs)


#: How a peer retells a document: in other words, in part, with one fact changed, or about something else of the same name.
KINDS = ("paraphrase", "summary", "variant", "homonym")
HOME = ("{s} was {f} {a}.", "{s} is known to be {f} {a}.")
AWAY = ("They say that {s}, {f} {a}, is worth a visit.", "In our notes {s} stands as {f} {a}.")


def told(random: SplitMix64, forms: tuple[str, ...], subject: str, facts: list[tuple[str, str]]) -> str:
    return " ".join(forms[random.below(len(forms))].format(s=subject, f=f, a=a) for f, a in facts)


def crossing(seed: int, number: int, nodes: int, peers: int) -> tuple:
    """A home document and what one of its node's next `peers` in the ring makes of its subject.

    No sentence is on both sides. A paraphrase states all facts, a summary the first two, a variant all with one answer
    changed; a homonym shares the name and has facts of its own.
    """
    random = SplitMix64.derived(seed ^ MASK, number & MASK)
    home, subject = number % nodes, f"{name(random)}{number:x}"
    answer = lambda k: name(random) if k % 2 else str(1000 + random.below(1000))
    facts = [(FACTS[k], answer(k)) for k in range(len(FACTS))]
    kind, away = KINDS[random.below(len(KINDS))], (home + 1 + random.below(min(peers, nodes - 1))) % nodes
    theirs = list(facts)
    if kind == "summary":
        theirs = facts[:2]
    elif kind == "variant":
        k = random.below(len(facts))
        while theirs[k] == facts[k]:
            theirs[k] = (FACTS[k], answer(k))
    elif kind == "homonym":
        theirs = [(f"counted among the {name(random).lower()}s of", name(random)) for _ in range(2)]
    pairs = lambda rows: [{"fact": f, "answer": a} for f, a in rows]
    return number, kind, f"node{home}", f"node{away}", subject, told(random, HOME, subject, facts), told(random, AWAY, subject, theirs), pairs(facts), pairs(theirs)


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.documents, self.seed = int(options.get("documents", "100")), int(options.get("seed", "1"))
        self.nodes, self.width = int(options.get("nodes", "3")), int(options.get("rangewidth", options.get("rangeWidth", "1000")))
        self.low, self.high = 0, self.documents

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("number",):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f  # ranges are pruned; Spark still tests each row

    def partitions(self) -> list[InputPartition]:
        return [IdRange(a, min(a + self.width, self.high)) for a in range(self.low, self.high, self.width)] or [IdRange(0, 0)]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        for number in range(partition.low, partition.high):
            yield self.make(number)

    def make(self, number: int) -> tuple:
        return document(self.seed, number, self.nodes)


class CrossingReader(CorpusReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.peers = int(options.get("peers", "2"))

    def make(self, number: int) -> tuple:
        return crossing(self.seed, number, self.nodes, self.peers)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_corpus"

    def schema(self) -> str:
        return "number long, node string, subject string, text string, paragraphs int"

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options)


class CrossingSource(DataSource):
    """`tessera_crossings`: home documents of several nodes, each with a peer's document about the same name."""

    @classmethod
    def name(cls) -> str:
        return "tessera_crossings"

    def schema(self) -> str:
        facts = "array<struct<fact: string, answer: string>>"
        return f"number long, kind string, node string, peer string, subject string, text string, peer_text string, facts {facts}, peer_facts {facts}"

    def reader(self, schema) -> DataSourceReader:
        return CrossingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
    spark.dataSource.register(CrossingSource)
