"""Configurations: frozen settings that compile to plans, checked before anything is read."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from quillrank.functions.text import HANGUL_LATIN, Scripts
from quillrank.functions.vectors import SIMILARITIES
from quillrank.operators.encoding import ENCODERS


class ConfigError(ValueError):
    pass


RETRIEVERS = ("bm25", "dense")
TASK_TYPES = ("retrieval", "pairs_retrieval", "mcq")


@dataclass(frozen=True)
class Cutoffs:
    ndcg: int = 10
    mrr: int = 10
    recall: int = 20

    @property
    def k(self) -> int:
        return max(self.ndcg, self.mrr, self.recall)


@dataclass(frozen=True)
class Bootstrap:
    iterations: int = 1000
    confidence: float = 0.95
    seed: str = "0"


@dataclass(frozen=True)
class Retriever:
    type: str = "bm25"
    k1: float = 1.2
    b: float = 0.75
    tokenizer: str = "char_bigram"
    encoder: str = "hashing"
    dim: int = 256
    batch_size: int = 32
    max_length: int | None = 512
    normalize: bool = True
    similarity: str = "cosine"
    query_prefix: str = ""
    document_prefix: str = ""
    #: The route that a model takes for each role, where it has more than one.
    routes: dict[str, str] = field(default_factory=dict)
    scripts: Scripts = HANGUL_LATIN

    def __post_init__(self):
        if self.type not in RETRIEVERS:
            raise ConfigError(f"unknown retriever {self.type!r}; known: {', '.join(RETRIEVERS)}")
        if self.type == "dense":
            if self.similarity not in SIMILARITIES:
                raise ConfigError(f"unknown similarity {self.similarity!r}; known: {', '.join(SIMILARITIES)}")
            if self.encoder != "hashing" and self.encoder not in ENCODERS:
                raise ConfigError(f"unknown encoder {self.encoder!r}; known: hashing, {', '.join(ENCODERS)}")


@dataclass(frozen=True)
class Task:
    name: str
    type: str
    split: str
    settings: dict = field(default_factory=dict)
    enabled: bool = True
    retriever: Retriever = Retriever()
    subgroup_fields: tuple[str, ...] = ()
    thresholds: tuple[int, ...] = ()
    headline: str = "ndcg"

    def __post_init__(self):
        if self.type not in TASK_TYPES:
            raise ConfigError(f"unknown task type {self.type!r}; known: {', '.join(TASK_TYPES)}")


@dataclass(frozen=True)
class Evaluation:
    tasks: tuple[Task, ...]
    cutoffs: Cutoffs = Cutoffs()
    bootstrap: Bootstrap = Bootstrap()
    locked_splits: tuple[str, ...] = ("test",)

    def runnable(self) -> tuple[list[Task], list[tuple[str, str]]]:
        """Tasks to run, and the names of the others with why not; nothing of these is read."""
        run, skip = [], []
        for t in self.tasks:
            if not t.enabled:
                skip.append((t.name, "disabled"))
            elif t.split in self.locked_splits:
                skip.append((t.name, f"split {t.split} is locked"))
            else:
                run.append(t)
        return run, skip


def merge_model(config: dict, models: dict | None, key: str | None) -> dict:
    """The configuration with one model's settings over its retriever's; both or neither are given."""
    if (models is None) != (key is None):
        raise ConfigError("a model matrix and a model key go together")
    out = copy.deepcopy(config)
    if models is not None:
        if key not in models.get("models", {}):
            raise ConfigError(f"unknown model {key!r}; known: {', '.join(sorted(models.get('models', {})))}")
        out["retriever"] = {**out.get("retriever", {}), **models["models"][key]}
    return out


def _retriever(settings: dict) -> Retriever:
    known = {k: v for k, v in settings.items() if k in Retriever.__dataclass_fields__}
    return Retriever(**known)


def compile_config(config: dict) -> Evaluation:
    """A parsed JSON configuration as an :class:`Evaluation`; wrong names fail here."""
    tasks = []
    for t in config.get("tasks", []):
        missing = [k for k in ("name", "type", "split") if k not in t]
        if missing:
            raise ConfigError(f"a task lacks {', '.join(missing)}")
        tasks.append(Task(t["name"], t["type"], str(t["split"]), {k: v for k, v in t.items() if k not in ("name", "type", "enabled", "retriever", "code_switch_thresholds")}, bool(t.get("enabled", True)),
                          _retriever(t.get("retriever", config.get("retriever", {}))), tuple(t.get("subgroup_fields", ())),
                          tuple(t.get("code_switch_thresholds", config.get("code_switch_thresholds", ()))), t.get("headline_metric", "accuracy" if t["type"] == "mcq" else "ndcg")))
    b = config.get("bootstrap", {})
    return Evaluation(tuple(tasks), Cutoffs(**config.get("cutoffs", {})), Bootstrap(b.get("iterations", 1000), b.get("confidence", 0.95), str(b.get("seed", 0))),
                      tuple(config.get("locked_splits", ["test"])))
