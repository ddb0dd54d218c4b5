"""Hyper-parameters and their names."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from enum import IntEnum

from .errors import InvalidArgument


class ModelKind(IntEnum):
    CBOW = 1
    SKIPGRAM = 2
    SUPERVISED = 3


class LossKind(IntEnum):
    HS = 1
    NS = 2
    SOFTMAX = 3
    OVA = 4


_KINDS = {"cbow": ModelKind.CBOW, "sg": ModelKind.SKIPGRAM, "skipgram": ModelKind.SKIPGRAM, "sup": ModelKind.SUPERVISED, "supervised": ModelKind.SUPERVISED}
_LOSSES = {"hs": LossKind.HS, "ns": LossKind.NS, "softmax": LossKind.SOFTMAX, "ova": LossKind.OVA, "one-vs-all": LossKind.OVA, "ovr": LossKind.OVA}


def model_kind(name: str) -> ModelKind:
    if name not in _KINDS:
        raise InvalidArgument(f"no model named {name!r}")
    return _KINDS[name]


def loss_kind(name: str) -> LossKind:
    if name not in _LOSSES:
        raise InvalidArgument(f"no loss named {name!r}")
    return _LOSSES[name]


@dataclass(frozen=True)
class Params:
    """All hyper-parameters; the thirteen that model files hold are in FILE_FIELDS."""

    lr: float = 0.05
    lr_update_rate: int = 100
    dim: int = 100
    ws: int = 5
    epoch: int = 5
    min_count: int = 5
    min_count_label: int = 0
    neg: int = 5
    word_ngrams: int = 1
    loss: LossKind = LossKind.NS
    model: ModelKind = ModelKind.SKIPGRAM
    bucket: int = 2_000_000
    minn: int = 3
    maxn: int = 6
    #: Parts that train on their own within an epoch; 1 trains on one document after the other.
    thread: int = 12
    t: float = 1e-4
    label: str = "__label__"
    verbose: int = 2
    pretrained_vectors: str = ""
    save_output: bool = False
    seed: int = 0
    qout: bool = False
    retrain: bool = False
    qnorm: bool = False
    cutoff: int = 0
    dsub: int = 2
    autotune_validation_file: str = ""
    autotune_metric: str = "f1"
    autotune_predictions: int = 1
    autotune_duration: int = 300
    autotune_model_size: str = ""

    @property
    def has_autotune(self) -> bool:
        return bool(self.autotune_validation_file)

    @classmethod
    def supervised(cls, **given) -> Params:
        """Defaults of supervised training under what is given.

        Without word or character n-grams the bucket is 0, decided after what is given.
        """
        own = cls(**{"model": ModelKind.SUPERVISED, "loss": LossKind.SOFTMAX, "min_count": 1, "minn": 0, "maxn": 0, "lr": 0.1, **given})
        if "bucket" not in given and own.word_ngrams <= 1 and own.maxn == 0 and not own.has_autotune:
            own = replace(own, bucket=0)
        return own.checked()

    @classmethod
    def unsupervised(cls, kind: str = "skipgram", **given) -> Params:
        return cls(**{"model": model_kind(kind), **given}).checked()

    def checked(self) -> Params:
        for name in ("dim", "epoch", "thread", "ws", "dsub"):
            least = 0 if name == "epoch" else 1
            if getattr(self, name) < least:
                raise InvalidArgument(f"{name} must be {least} or more")
        if self.bucket < 0 or self.minn < 0 or self.maxn < 0 or self.lr < 0:
            raise InvalidArgument("bucket, minn, maxn and lr must not be negative")
        return self

    def as_rows(self) -> list[tuple[str, str]]:
        return [(f.name, str(getattr(self, f.name))) for f in fields(self)]


#: Order of the fields in a model file: twelve 32-bit integers and a double.
FILE_FIELDS = ("dim", "ws", "epoch", "min_count", "neg", "word_ngrams", "loss", "model", "bucket", "minn", "maxn", "lr_update_rate", "t")

_METRICS = {"f1": "f1", "precisionAtRecall": "precision_at_recall", "recallAtPrecision": "recall_at_precision"}


def parse_metric(text: str) -> tuple[str, float | None, str | None]:
    """(metric, bound in percent, label) of "f1", "f1:label", "precisionAtRecall:30[:label]" and the reverse."""
    name, *rest = text.split(":", 2)
    if name not in _METRICS:
        raise InvalidArgument(f"no metric {text!r}")
    if name == "f1":
        return "f1", None, text.partition(":")[2] or None
    if not rest:
        raise InvalidArgument(f"{name} needs a bound")
    return _METRICS[name], float(rest[0]), rest[1] if len(rest) > 1 else None


def parse_size(text: str) -> int:
    """Bytes of "100", "1.5M", "2gb": K, M and G, with or without B, are powers of 1024."""
    said = text.strip().upper().removesuffix("B")
    unit = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}.get(said[-1:])
    try:
        return int(float(said[:-1].strip() if unit else said) * (unit or 1))
    except ValueError:
        raise InvalidArgument(f"no size: {text!r}") from None
