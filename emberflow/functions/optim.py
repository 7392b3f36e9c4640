"""Optimizers as column expressions over (emb, opt, grad)."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Optimizer(Protocol):
    """What a table needs of an optimizer."""

    def state_size(self, dim: int) -> int: ...

    def initial_state(self, dim: int) -> Column: ...

    def step(self, emb: Column, opt: Column, grad: Column, steps: Column) -> tuple[Column, Column]:
        """New weights and state; ``steps``: batches so far, this one included, for the key's group."""
        ...


def _filled(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)).cast("float"), n)


def _f(v: Column) -> Column:
    return v.cast("array<float>")


@dataclass(frozen=True)
class SGD:
    """w - lr * (g + wd * w). ``momentum`` is accepted and has no effect."""

    lr: float = 1e-2
    weight_decay: float = 0.0
    momentum: float = 0.0

    def __post_init__(self) -> None:
        if self.momentum:
            warnings.warn("momentum has no effect", stacklevel=2)

    def state_size(self, dim: int) -> int:
        return 0

    def initial_state(self, dim: int) -> Column:
        return F.array().cast("array<float>")

    def step(self, emb: Column, opt: Column, grad: Column, steps: Column) -> tuple[Column, Column]:
        return _f(F.zip_with(emb, grad, lambda w, g: w - self.lr * (g + self.weight_decay * w))), opt


@dataclass(frozen=True)
class Adagrad:
    """w - lr * g / sqrt(s + eps) with the old s; then s * momentum + g**2, or the mean of g**2 if shared."""

    lr: float = 1e-2
    initial_accumulator_value: float = 1e-2
    g_square_momentum: float = 1.0
    eps: float = 1e-10
    vectorwise_shared: bool = False
    weight_decay: float = 0.0

    def __post_init__(self) -> None:
        if self.weight_decay:
            warnings.warn("weight_decay has no effect", stacklevel=2)

    def state_size(self, dim: int) -> int:
        return 1 if self.vectorwise_shared else dim

    def initial_state(self, dim: int) -> Column:
        return _filled(self.initial_accumulator_value, self.state_size(dim))

    def step(self, emb: Column, opt: Column, grad: Column, steps: Column) -> tuple[Column, Column]:
        m = self.g_square_momentum
        if self.vectorwise_shared:
            s = F.get(opt, F.lit(0)).cast("double")
            mean = F.aggregate(grad, F.lit(0.0), lambda a, g: a + g.cast("double") * g) / F.size(grad)
            return _f(F.zip_with(emb, grad, lambda w, g: w - self.lr * g / F.sqrt(s + self.eps))), _f(F.array(s * m + mean))
        at = lambda i: F.get(opt, i).cast("double")
        new = F.transform(emb, lambda w, i: w - self.lr * F.get(grad, i) / F.sqrt(at(i) + self.eps))
        return _f(new), _f(F.zip_with(opt, grad, lambda s, g: s.cast("double") * m + g.cast("double") * g))


@dataclass(frozen=True)
class Adam:
    """Adam; the powers of the betas run one ahead of the step, so the first uses their squares."""

    lr: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    weight_decay: float = 0.0

    def __post_init__(self) -> None:
        if self.weight_decay:
            warnings.warn("weight_decay has no effect", stacklevel=2)

    def state_size(self, dim: int) -> int:
        return 2 * dim

    def initial_state(self, dim: int) -> Column:
        return _filled(0.0, 2 * dim)

    def powers(self, steps: Column) -> tuple[Column, Column]:
        return F.pow(F.lit(self.beta1), steps + 1), F.pow(F.lit(self.beta2), steps + 1)

    def step(self, emb: Column, opt: Column, grad: Column, steps: Column) -> tuple[Column, Column]:
        dim = F.size(emb)
        b1, b2 = self.beta1, self.beta2
        m = F.zip_with(F.slice(opt, F.lit(1), dim), grad, lambda m, g: b1 * m + (1 - b1) * g)
        v = F.zip_with(F.slice(opt, dim + 1, dim), grad, lambda v, g: b2 * v + (1 - b2) * g.cast("double") * g)
        p1, p2 = self.powers(steps)
        move = F.zip_with(m, v, lambda m, v: self.lr * (m / (1 - p1)) / (self.eps + F.sqrt(v / (1 - p2))))
        return _f(F.zip_with(emb, move, lambda w, d: w - d)), _f(F.concat(m, v))


def to_dict(optimizer: Optimizer) -> dict:
    """Kind and hyper-parameters of an optimizer of this module; of any other its name only."""
    kind = type(optimizer).__name__
    return {"kind": kind} | (asdict(optimizer) if isinstance(optimizer, (SGD, Adagrad, Adam)) else {})


def from_dict(d: dict) -> Optimizer:
    kinds = {c.__name__: c for c in (SGD, Adagrad, Adam)}
    if d["kind"] not in kinds:
        raise ValueError(f"the checkpoint was made with {d['kind']}; give the session such an optimizer")
    return kinds[d["kind"]](**{k: v for k, v in d.items() if k != "kind"})
