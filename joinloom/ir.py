"""Folds over joins and fold pipelines as values, independent of any engine.

A fold joins operands on dimensions (one key column of an operand at most for each), forms a value for each joined row and sums it, or
folds it in another monoid, over the dimensions that are not shown. A pipeline feeds the result of one fold, as a weight, into a second.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.expressions import Expression

MONOIDS = ("sum", "count", "avg", "min", "max", "bool_and", "bool_or")
COMPARISONS = ("<", "<=", ">", ">=")


@dataclass(frozen=True)
class Dimension:
    """One variable: the key columns that a join equates. ``null_safe``: NULL equals NULL, as IS NOT DISTINCT FROM has it."""

    name: str
    null_safe: bool = False


@dataclass(frozen=True)
class Operand:
    """Key columns by dimension, and the column with the factor; without one the operand only admits rows."""

    keys: dict[str, str]
    factor: str | None = None

    def __hash__(self) -> int:
        return hash((tuple(sorted(self.keys.items())), self.factor))


@dataclass(frozen=True)
class Condition:
    """``left op right + offset`` between the keys of two dimensions."""

    left: str
    op: str
    right: str
    offset: int = 0


@dataclass(frozen=True)
class Domain:
    """A relation whose every row gets the fold's value of its keys, else ``missing`` (None: NULL)."""

    keys: dict[str, str]
    columns: tuple[str, ...]
    missing: float | None = None

    def __hash__(self) -> int:
        return hash((tuple(sorted(self.keys.items())), self.columns, self.missing))


@dataclass(frozen=True)
class Fold:
    """``value``: None for the product of all factors, or an expression over columns (operand number, column name)."""

    operands: tuple[Operand, ...]
    dimensions: tuple[Dimension, ...]
    outputs: tuple[str, ...]
    value: Expression | None = None
    aggregate: str = "sum"
    domain: Domain | None = None
    conditions: tuple[Condition, ...] = ()

    def __post_init__(self) -> None:
        names = [d.name for d in self.dimensions]
        if len(set(names)) != len(names):
            raise ValueError("two dimensions of one name")
        if not self.operands:
            raise ValueError("a fold has operands")
        for o in self.operands:
            if unknown := set(o.keys) - set(names):
                raise ValueError(f"unknown dimensions {sorted(unknown)}")
            if len(set(o.keys.values())) != len(o.keys):
                raise ValueError("one column for two dimensions of an operand")
        if free := set(names) - {d for o in self.operands for d in o.keys}:
            raise ValueError(f"no operand has {sorted(free)}")
        if len(set(self.outputs)) != len(self.outputs) or set(self.outputs) - set(names):
            raise ValueError("outputs are distinct dimensions")
        if self.value is None and not any(o.factor for o in self.operands) and self.aggregate != "count":
            raise ValueError("a product has a factor")
        if self.value is not None and any(not 0 <= i < len(self.operands) for i, _ in self.value.columns()):
            raise ValueError("the expression reads an operand that isn't there")
        if self.aggregate not in MONOIDS:
            raise ValueError(f"unknown aggregate {self.aggregate}")
        if self.domain is not None and set(self.domain.keys) != set(self.outputs):
            raise ValueError("a domain has a key for each output")
        for c in self.conditions:
            if c.left == c.right or {c.left, c.right} - set(names) or c.op not in COMPARISONS:
                raise ValueError(f"not a condition between two dimensions: {c}")

    @property
    def is_einsum(self) -> bool:
        return self.value is None and self.aggregate == "sum"

    def dims_of(self, i: int) -> frozenset[str]:
        return frozenset(self.operands[i].keys)

    def null_safe(self, name: str) -> bool:
        return next(d.null_safe for d in self.dimensions if d.name == name)


@dataclass(frozen=True)
class Scale:
    """The score is p, p * by, or p / by."""

    by: float | None = None
    divides: bool = False


@dataclass(frozen=True)
class Weight:
    """exp of the scaled score, shifted by its maximum over the kept dimensions or not; or an expression of the score (column (0, "s"))."""

    of: Expression | None = None
    scale: Scale = field(default_factory=Scale)
    shifted: bool = True


@dataclass(frozen=True)
class Pipeline:
    """``producer`` gives a score for each (kept, summed) pair, ``weight`` a weight of it; weights times values of a third operand are summed over ``summed``.

    normalizer: "groups" divides by the sum of all weights of the kept key, "rows" by the sum over the rows
    joined with values, None doesn't divide.
    """

    producer: Fold
    weight: Weight
    values: Operand
    summed: tuple[str, ...]
    normalizer: str | None = "groups"

    def __post_init__(self) -> None:
        if self.producer.domain is not None or self.producer.aggregate != "sum":
            raise ValueError("the producer is a sum without a domain")
        if not self.values.factor:
            raise ValueError("values have a factor")
        if set(self.summed) - set(self.producer.outputs) or set(self.summed) - set(self.values.keys):
            raise ValueError("summed dimensions are outputs of the producer and keys of the values")
        if self.weight.of is not None and self.weight.of.columns() - {(0, "s")}:
            raise ValueError("a weight reads the score alone")
        if self.normalizer not in ("groups", "rows", None):
            raise ValueError(f"unknown normalizer {self.normalizer}")

    @property
    def kept(self) -> tuple[str, ...]:
        return tuple(d for d in self.producer.outputs if d not in self.summed)


def describe(f: Fold | Pipeline) -> str:
    """One line: operands and conditions to outputs, as in ``a,b * b,c -> a,c where a >= c``."""
    if isinstance(f, Pipeline):
        weight = "f" if f.weight.of else "exp" if not f.weight.shifted else "softmax" if f.normalizer else "exp shifted"
        by = "" if f.weight.scale.by is None else f"({'/' if f.weight.scale.divides else '*'} {f.weight.scale.by:g})"
        out = [*f.kept, *(d for d in f.values.keys if d not in f.producer.outputs)]
        return f"{weight}{by}[{describe(f.producer)}] * {','.join(f.values.keys)} -> {','.join(out)}" + (f" / {f.normalizer}" if f.normalizer else "")
    parts = [",".join(o.keys) + ("" if o.factor or f.value is not None else "?") for o in f.operands]
    text = f"{' * '.join(parts)} -> {','.join(f.outputs)}"
    text = text if f.aggregate == "sum" else f"{f.aggregate}[{text}]"
    if f.domain:
        text += " + domain" + ("" if f.domain.missing is None else f" else {f.domain.missing:g}")
    if f.conditions:
        text += " where " + " and ".join(f"{c.left} {c.op} {c.right}" + (f" {c.offset:+d}" if c.offset else "") for c in f.conditions)
    return text
