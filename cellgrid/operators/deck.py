"""Decks of nested subsets: which cells a card selects, and in which order cards are computed."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_BINARY = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__"}
NAME = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\Z")


def expression(text: str, columns: list[str]) -> Column:
    """A boolean expression over cell attributes as a Column. Only attributes, literals, comparisons, arithmetic, and/or/not/&/|/~ and membership are allowed."""

    def walk(node: ast.AST):
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=value) if isinstance(value, (int, float, str, bool)):
                return F.lit(value)
            case ast.Name(id=name) if name in columns:
                return F.col(name)
            case ast.Attribute(value=ast.Attribute(value=ast.Name(id="ds"), attr="ca"), attr=name) if name in columns:
                return F.col(name)
            case ast.BoolOp(op=op, values=values):
                out = walk(values[0])
                for v in values[1:]:
                    out = out & walk(v) if isinstance(op, ast.And) else out | walk(v)
                return out
            case ast.BinOp(left=left, op=ast.BitAnd(), right=right):
                return walk(left) & walk(right)
            case ast.BinOp(left=left, op=ast.BitOr(), right=right):
                return walk(left) | walk(right)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return getattr(walk(left), _BINARY[type(op)])(walk(right))
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=operand):
                return ~walk(operand)
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -walk(operand)
            case ast.Compare(left=left, ops=[ast.In() | ast.NotIn() as op], comparators=[ast.List(elts=elts) | ast.Tuple(elts=elts)]):
                inside = walk(left).isin(*[walk(e) for e in elts])
                return ~inside if isinstance(op, ast.NotIn) else inside
            case ast.Compare(left=left, ops=ops, comparators=comparators) if all(type(op) in _COMPARE for op in ops):
                out, before = None, walk(left)
                for op, right in zip(ops, comparators, strict=True):
                    after = walk(right)
                    one = getattr(before, _COMPARE[type(op)])(after)
                    out, before = one if out is None else out & one, after
                return out
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    return walk(ast.parse(text, mode="eval"))


@dataclass
class Subset:
    """One entry of a card: cells of the clusters that carry one of the tags in ``include`` and satisfy ``onlyif``."""

    name: str
    include: list = field(default_factory=list)
    onlyif: str | None = None
    params: dict = field(default_factory=dict)
    steps: list = field(default_factory=list)
    execution: dict = field(default_factory=dict)
    card: str = "Root"

    @property
    def longname(self) -> str:
        return self.name if self.card == "Root" else f"{self.card}_{self.name}"


@dataclass
class View(Subset):
    sources: list = field(default_factory=list)


@dataclass
class Card:
    name: str
    subsets: dict[str, Subset]
    parent: Card | None = None

    def depends(self) -> str | None:
        return self.name if self.parent else None


class Deck:
    """Cards loaded from ``Root.yaml``, ``X.yaml``, ``X_Y.yaml`` …, and views from a folder ``views`` beside them.

    ``source`` is a folder of this machine, or the texts of its files by their paths below it.
    """

    def __init__(self, source: str | Path | dict[str, str]):
        files = source if isinstance(source, dict) else {p.relative_to(source).as_posix(): p.read_text() for p in sorted(Path(source).rglob("*.yaml"))}
        if "Root.yaml" not in files:
            raise FileNotFoundError(f"{'the deck' if isinstance(source, dict) else source} has no Root.yaml")
        self.root = self._load(files, "Root", None)
        self.cards: dict[str, Card] = {}
        self._register(self.root, files)
        self.views = {name[6:-5]: self._view(name[6:-5], files[name]) for name in sorted(files) if name.startswith("views/")}
        for name in self.views:
            if name in self.subsets():
                raise ValueError(f"view {name} has the name of a subset")
        for subset in self.root.subsets.values():
            if subset.onlyif:
                raise ValueError("the Root card can't have onlyif")

    @staticmethod
    def _load(files: dict[str, str], name: str, parent: Card | None) -> Card:
        spec = yaml.safe_load(files[f"{name}.yaml"]) or {}
        subsets = {}
        for key, body in spec.items():
            if not NAME.match(str(key)) or key == "Pool":
                raise ValueError(f"{key!r} is no name for a subset")
            subsets[key] = Subset(key, **{k: v for k, v in (body or {}).items() if v is not None}, card=name)
        return Card(name, subsets, parent)

    def _register(self, card: Card, files: dict[str, str]) -> None:
        self.cards[card.name] = card
        for subset in card.subsets.values():
            if f"{subset.longname}.yaml" in files:
                self._register(self._load(files, subset.longname, card), files)

    @staticmethod
    def _view(name: str, text: str) -> View:
        body = yaml.safe_load(text) or {}
        if not body.get("sources"):
            raise ValueError(f"view {name} has no sources")
        return View(name, **{k: v for k, v in body.items() if v is not None})

    def subsets(self) -> dict[str, Subset]:
        return {s.longname: s for c in self.cards.values() for s in c.subsets.values()}

    def leaves(self) -> list[str]:
        """Subsets without a card of their own."""
        return [n for n in self.subsets() if n not in self.cards]

    def tasks(self) -> dict[str, list[str]]:
        """Every task with the tasks that it needs: subsets need the subset that their card divides, views their sources, Pool all leaves."""
        out = {n: [] if s.card == "Root" else [s.card] for n, s in self.subsets().items()}
        out |= {n: list(v.sources) for n, v in self.views.items()}
        return out | {"Pool": self.leaves()}


def topological(tasks: dict[str, list[str]]) -> list[str]:
    """Tasks after all that they need; a cycle or an unknown task is an error."""
    done: list[str] = []
    state: dict[str, int] = {}

    def visit(task: str, path: tuple[str, ...]) -> None:
        if task not in tasks:
            raise ValueError(f"{path[-1]} needs {task}, which is no task")
        if state.get(task) == 1:
            raise ValueError(f"tasks need each other: {' > '.join((*path, task))}")
        if task not in state:
            state[task] = 1
            for other in tasks[task]:
                visit(other, (*path, task))
            state[task] = 2
            done.append(task)

    for task in tasks:
        visit(task, ())
    return done


def matches(tags: Column, include: list, categories: dict[str, list[str]], taken: Column | None = None) -> Column:
    """Whether a cluster's tags hit an include list: tags, or names of categories of tags; an empty list takes all that is not taken yet."""
    if not include:
        return F.lit(True) if taken is None else ~taken
    names = [n for item in include for n in (item if isinstance(item, list) else [item])]
    wanted = sorted({t for n in names for t in categories.get(n, [n])})
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def first_match(cells: DataFrame, subsets: list[Subset], tags_col: str = "tags", categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``subset``: the first subset whose tags and expression a cell satisfies, else null."""
    tags = F.split(F.col(tags_col), " ")
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in subsets:
        hit = matches(tags, s.include, categories or {})
        if s.onlyif:
            hit = hit & expression(s.onlyif, cells.columns)
        chosen = chosen.when(hit, F.lit(s.longname))
    return cells.withColumn("subset", chosen)


def pooled(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of labelled cells with their source's name; cluster numbers are moved on by the sizes of the sources before."""
    out, moved = None, F.lit(0).cast("long")
    tops = [p.agg((F.max("clusters") + 1).alias("top")) for _, p in parts]
    for k, (name, part) in enumerate(parts):
        rows = part.withColumn("source", F.lit(name)).withColumn("source_clusters", F.col("clusters"))
        for top in tops[:k]:
            rows = rows.crossJoin(F.broadcast(top)).withColumn("clusters", F.col("clusters") + F.coalesce("top", moved)).drop("top")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def split_name(i: int) -> str:
    """A, B, …, Z, AA, BB, …"""
    return chr(65 + i % 26) * (1 + i // 26)


#: Processors asked for by the number of cells: that of the nearest anchor. Fixed values.
CPU_ANCHORS = ((100, 1), (1_000, 3), (10_000, 7), (100_000, 14), (500_000, 28), (1_000_000, 28), (2_000_000, 56))


def cpus_for(cells: int) -> int:
    return min(CPU_ANCHORS, key=lambda a: (abs(a[0] - cells), a[1]))[1]


def emit_card(parts: list[tuple[int, int]], memory: int) -> str:
    """The YAML of a card that divides cells by their attribute ``split``: for each (value, cells) a subset with the processors and memory that it needs."""
    spec = {}
    for i, (value, cells) in enumerate(parts):
        n_cpus = cpus_for(cells)
        spec[split_name(i)] = {"include": [], "onlyif": f"split == {value}", "execution": {"n_cpus": n_cpus, "memory": 750 if n_cpus == 56 else memory}}
    return yaml.safe_dump(spec, sort_keys=False)
