"""Control plane: index and strategy selection, caches, decomposition, and the router.

Pure functions on the driver, with models as optional arguments; without one
the heuristics decide. Column forms of the heuristics serve whole tables of
queries.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.functions.values import has_any, json_answer  # noqa: F401
from corpuslode.functions.vectors import hash_vector
from corpuslode.operators.stats import running

# Strategies by reliability, and words in queries that favour some of them.
PRIORITY = ("vector", "hybrid", "recursive", "chunk_decoupling", "planner", "metadata", "summary")
PLACES = ("จังหวัด", "อำเภอ", "ตำบล", "กรุงเทพ", "สมุทรปราการ", "นนทบุรี")
DEEDS = ("โฉนด", "นส.3", "นส.4", "ส.ค.1")
SIMPLE = ("what", "show", "list", "find", "get", "which")
SIMPLE_THAI = ("อะไร", "แสดง", "หา")
COMPLEX = ("first", "then", "analyze", "compare", "breakdown", "step")
COMPLEX_THAI = ("ขั้นตอน", "วิเคราะห์")
COMPARISON = ("compare", "versus", "vs", "difference", "similar")
# Size and lifetime of the query cache, limits of the planner.
CACHE_SIZE, CACHE_SECONDS = 500, 1800
MAX_SUB_QUESTIONS, DECOMPOSE_ABOVE = 5, 4

#: Rules in their order: words, whether they are looked for in the query as it is, strategies of which the first available is taken.
LAND_RULES = (
    (PLACES, True, ("metadata",)), (DEEDS, True, ("hybrid",)), (SIMPLE + SIMPLE_THAI, False, ("vector",)), (COMPLEX + COMPLEX_THAI, False, ("planner", "recursive")),
)
GENERIC_RULES = ((SIMPLE, False, ("vector",)), (COMPLEX, False, ("planner", "recursive")), (COMPARISON, False, ("hybrid",)))


def select_strategy(query: str, available: Sequence[str], rules=LAND_RULES) -> str:
    """K3, K7: by the first rule with a word in the query and an available strategy, else by reliability."""
    known = [s for s in PRIORITY if s in available]
    if not known:
        return available[0] if available else "vector"
    for words, as_is, wanted in rules:
        if any(w in (query if as_is else query.lower()) for w in words):
            for s in wanted:
                if s in known:
                    return s
    if rules is GENERIC_RULES and known[0] == "metadata" and "compensation" in query.lower() and "vector" in known:
        return "vector"
    return known[0]


def strategy_column(query: Column, available: Sequence[str] = PRIORITY, rules=LAND_RULES) -> Column:
    """K3, K7 for a column of queries."""
    known = [s for s in PRIORITY if s in available]
    out = None
    for words, as_is, wanted in rules:
        strategy = next((s for s in wanted if s in known), None)
        if strategy is not None:
            hit = has_any(query if as_is else F.lower(query), words)
            out = F.when(hit, strategy) if out is None else out.when(hit, strategy)
    default = F.lit(known[0] if known else (available[0] if available else "vector"))
    return default if out is None else out.otherwise(default)


def round_robin(df: DataFrame, order: Sequence[str], strategies: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """K5: a counter for each index, so that each strategy takes its turn."""
    turn = (F.col("turn") - 1) % len(strategies)
    out = running(df, {"turn": F.lit(1)}, order, by).withColumn("turn", turn.cast("int"))
    return out.withColumn("assigned", F.element_at(F.array(*map(F.lit, strategies)), F.col("turn") + 1))


def parse_selection(answer: str, available: Sequence[str], query: str, rules=LAND_RULES) -> dict[str, Any]:
    """K4: a model's lines STRATEGY, CONFIDENCE, REASONING; a name that holds or is held by an available one counts less."""
    found = {k.strip(): v.strip() for k, _, v in (line.strip().partition(":") for line in answer.strip().split("\n"))}
    strategy = found.get("STRATEGY", "").lower()
    try:
        confidence = max(0.1, min(1.0, float(found.get("CONFIDENCE", "0.5"))))
    except ValueError:
        confidence = 0.5
    if strategy in available:
        return {"strategy": strategy, "confidence": confidence, "method": "llm_enhanced"}
    partly = [s for s in available if strategy and (s.lower() in strategy or strategy in s.lower())]
    if partly:
        return {"strategy": partly[0], "confidence": max(0.3, confidence - 0.2), "method": "llm_partial_match"}
    return {"strategy": select_strategy(query, available, rules), "confidence": 0.3, "method": "llm_fallback_heuristic"}


def choose_strategy(query: str, available: Sequence[str], llm: Callable[[str], str] | None = None, rules=LAND_RULES) -> dict[str, Any]:
    if llm is None:
        return {"strategy": select_strategy(query, available, rules), "confidence": 0.3, "method": "heuristic"}
    try:
        return parse_selection(llm(query), available, query, rules)
    except Exception as e:  # noqa: BLE001  whatever a model's client raises
        return {"strategy": select_strategy(query, available, rules), "confidence": 0.2, "method": "llm_error_fallback", "reasoning": str(e)}


def _cosine(a: Sequence[float], b: Sequence[float]) -> float:
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def classify_index(query: str, indices: dict[str, str], llm: Callable[[str], str] | None = None, embed: Callable[[str], Sequence[float]] = hash_vector) -> dict[str, Any]:
    """K1, K2: by a model, else by the description that is most similar to the query."""
    if llm is not None:
        try:
            name = llm(query).strip()
            return {"selected_index": name if name in indices else next(iter(indices)), "confidence": 0.9 if name in indices else 0.3, "method": "llm" if name in indices else "llm_fallback"}
        except Exception:  # noqa: BLE001
            pass
    q = embed(query)
    scores = {name: _cosine(q, embed(text)) for name, text in indices.items()}
    best = max(scores, key=lambda n: scores[n])
    return {"selected_index": best, "confidence": scores[best], "method": "embedding"}


def decompose(query: str, llm: Callable[[str], list[dict]] | None = None, most: int = MAX_SUB_QUESTIONS) -> list[dict[str, Any]]:
    """K9: sub-questions by priority (three if not given), or the query itself."""
    try:
        found = llm(query) if llm else []
    except Exception:  # noqa: BLE001
        found = []
    found = [{"question": s["question"], "purpose": s.get("purpose", ""), "priority": s.get("priority", 3)} for s in found if s.get("question")]
    return sorted(found, key=lambda s: s["priority"])[:most] or [{"question": query, "purpose": "original", "priority": 1}]


class TTLCache:
    """Least recently used goes first; an entry is a miss after its time."""

    def __init__(self, size: int = CACHE_SIZE, seconds: float = CACHE_SECONDS, clock: Callable[[], float] = time.time):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> Any:
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            self.misses += 1
            return None
        self.hits += 1
        self.held.move_to_end(key)
        return value

    def put(self, key: str, value: Any) -> None:
        self.held[key] = (self.clock(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def stats(self) -> dict[str, float]:
        n = self.hits + self.misses
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / n if n else 0.0}


def query_key(query: str, strategy: str, k: int, index: str) -> str:
    return hashlib.md5(f"{query.strip().lower()}|{strategy}|{k}|{index}".encode()).hexdigest()


def synthesize(texts: Sequence[str], llm: Callable[[str], str] | None = None) -> str:
    """By a model, else the first five texts."""
    if not texts:
        return "No relevant information found."
    body = "\n\n".join(texts[:5])
    return llm(body) if llm else f"Based on the retrieved information:\n\n{body}"


Retriever = Callable[[str, int], DataFrame]


@dataclass
class Router:
    """Index, strategy, cache, retrieval and log of a query."""

    indices: dict[str, str]
    retrievers: dict[str, dict[str, Retriever]] = field(default_factory=dict)
    llm: Callable[[str], str] | None = None
    cache: TTLCache = field(default_factory=TTLCache)
    log: list[dict[str, Any]] = field(default_factory=list)

    def add_retriever(self, index: str, strategy: str, retrieve: Retriever) -> None:
        self.retrievers.setdefault(index, {})[strategy] = retrieve

    def remove_retriever(self, index: str, strategy: str) -> None:
        self.retrievers.get(index, {}).pop(strategy, None)

    def query(self, text: str, k: int = 5) -> list[dict[str, Any]]:
        began = time.time()
        known = {n: d for n, d in self.indices.items() if self.retrievers.get(n)}
        if not known:
            raise ValueError("no index has a retriever")
        index = classify_index(text, known)["selected_index"]
        own = self.retrievers[index]
        strategy = choose_strategy(text, list(own), self.llm)["strategy"]
        strategy = strategy if strategy in own else next(iter(own))
        key, error = query_key(text, strategy, k, index), None
        rows = self.cache.get(key)
        if rows is None:
            try:
                rows = [r.asDict() | {"selected_index": index, "selected_strategy": strategy} for r in own[strategy](text, k).collect()]  # at most k rows
                self.cache.put(key, rows)
            except Exception as e:  # noqa: BLE001  a failed strategy gives no rows, and the log says why
                rows, error = [], str(e)
        self.log.append({"ts": began, "query": text, "index": index, "strategy": strategy, "latency_ms": round((time.time() - began) * 1000, 2), "error": error})
        return rows


def plan_and_execute(query: str, retrieve: Callable[[DataFrame], DataFrame], spark, score: float, llm=None, k: int = 5) -> DataFrame:
    """The sub-questions of a complex query as one table, answered by one Spark job."""
    parts = decompose(query, llm) if score > DECOMPOSE_ABOVE else [{"question": query, "purpose": "original", "priority": 1}]
    asked = spark.createDataFrame([(i, p["question"]) for i, p in enumerate(parts)], "query_id int, query string")
    return retrieve(asked).where(F.col("rank") <= k)


def union_strategies(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several strategies, told apart by name; Spark runs them as one job."""
    out = None
    for name, df in results.items():
        df = df.withColumn("strategy", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
