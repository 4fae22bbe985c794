"""Models of a theory: facts in, closure, facts out.

Single facts are kept on the driver until something needs them and are then written together; tables of
facts come in as DataFrames.  Everything that can be large comes out as a DataFrame.

Elements are 64-bit ids.  Ids that come in with facts (``load``) are elements of the columns' types, and fresh
elements never get an id that was seen.  Tables of types and memberships are written only where a rule reads
them; elsewhere they are put together from the facts when they are asked for.

``save`` notes the state of a model beside its tables, and ``reopen`` goes on from there, in another session.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang.errors import TheoryError
from .lang.parser import parse
from .operators import components, premise
from .operators.engine import Engine
from .operators.store import Store, scanned
from .plans.compiler import Compiler, Facts, RuleError, Walk, compile_theory
from .plans.ir import Compiled, Relation, member_relation


#: Results that come from this many bytes or more are computed by the model, not by whoever reads them; tables of as many
#: are dealt out before their rows are made distinct.
SETTLED_BYTES = 64 << 20


class Theory:
    """A compiled theory."""

    def __init__(self, source: str, name: str = "theory"):
        self.source, self.name = source, name
        self.compiled: Compiled = compile_theory(source, name)

    def model(self, spark: SparkSession, *, allow_cycles: bool = False) -> Model:
        return Model(spark, self, allow_cycles=allow_cycles)


def load_theory(path: str) -> Theory:
    """The theory in a file, named after it."""
    with open(path, encoding="utf-8") as f:
        return Theory(f.read(), os.path.splitext(os.path.basename(path))[0])


def load_theories(folder: str, suffix: str = ".eql") -> dict[str, Theory]:
    """All theories of a folder and the folders in it, by file name; texts that did not change are not compiled again."""
    found: dict[str, Theory] = {}
    for where, _, files in sorted(os.walk(folder, followlinks=True)):
        for f in sorted(files):
            if f.endswith(suffix):
                theory = load_theory(os.path.join(where, f))
                if theory.name in found:
                    raise ValueError(f"two theories are called {theory.name!r}")
                found[theory.name] = theory
    return found


class Model:
    def __init__(self, spark: SparkSession, theory: Theory, *, allow_cycles: bool = False, path: str | None = None):
        self.spark, self.theory, self.compiled = spark, theory, theory.compiled
        self.store = Store(spark, theory.compiled, path)
        self.engine = Engine(self.store, allow_cycles)
        self.pending: dict[str, list[tuple[int, ...]]] = {}
        self.frames: list[tuple[str, DataFrame]] = []
        self.equalities: list[tuple[str, int, int]] = []
        self.edge_frames: list[DataFrame] = []
        self.dictionaries: dict[str, DataFrame] = {}
        self.key_files: dict[str, tuple[list[str], str]] = {}  # of each dictionary: its files and their schema
        self.implied: set[str] = set()  # types and memberships with elements that only facts name

    # Identity -----------------------------------------------------------------------------------
    def relation(self, name: str, *kinds: str) -> Relation:
        try:
            r = self.compiled.relation(name)
        except KeyError:
            r = None
        if r is None or (kinds and r.kind not in kinds):
            raise KeyError(f"the theory has no {' or '.join(kinds) or 'relation'} {name!r}")
        return r

    def type_name(self, name: str) -> str:
        return self.relation(name, "type").name

    def root(self, type_name: str, element: int) -> int:
        """Canonical element of the class; an element that was never merged is its own."""
        type_name = self.type_name(type_name)
        if self.engine.union_whole:
            union = self.engine.union.get(type_name)
            return union.root(element) if union else element
        found = self.engine.roots_table(type_name).where(F.col("el") == element).first()
        return found["root"] if found else element

    def are_equal(self, type_name: str, a: int, b: int) -> bool:
        return self.root(type_name, a) == self.root(type_name, b)

    def roots(self, name: str, args: tuple[int, ...]) -> tuple[int, ...]:
        r = self.relation(name)
        if r.width and len(args) > r.width:
            raise ValueError(f"{name} takes {r.width} elements")
        return tuple(self.root(t, a) for t, a in zip(r.columns, args, strict=False))

    # Facts in -----------------------------------------------------------------------------------
    def new(self, type_name: str, parent: int | None = None) -> int:
        """A fresh element; one of a member type needs the model element it belongs to."""
        type_name = self.type_name(type_name)
        model = self.compiled.member_types.get(type_name)
        if (model is None) != (parent is None):
            raise ValueError(f"{type_name} {'needs' if model else 'has no'} parent")
        if type_name in self.compiled.enums:
            raise ValueError(f"{type_name} is an enum: use a constructor")
        element = self.fresh(type_name)
        if model:
            self.insert(member_relation(model, type_name), parent, element)
        return element

    def fresh(self, type_name: str) -> int:
        if any(type_name in self.relation(n).columns for n, _ in self.frames):
            self.flush()
        self.engine.raise_ids({type_name})
        element = self.engine.next_id[type_name]
        self.engine.next_id[type_name] += 1
        self.pending.setdefault(type_name, []).append((element,))
        return element

    def insert(self, name: str, *args: int) -> None:
        r = self.relation(name, "pred", "func", "ctor", "member")
        name = r.name
        if len(args) != r.width:
            raise ValueError(f"{name} takes {r.width} elements, not {len(args)}")
        self.pending.setdefault(name, []).append(self.roots(name, args) or (0,))

    def define(self, name: str, *args: int) -> int:
        """Value of a function, made if there is none."""
        r = self.relation(name, "func", "ctor")
        name = r.name
        found = self.eval(name, *args)
        if found is not None:
            return found
        sort = r.columns[-1]
        if sort in self.compiled.enums and r.kind != "ctor":
            raise ValueError(f"an element of {sort} comes from a constructor only")
        element = self.fresh(sort)
        self.insert(name, *args, element)
        model = self.compiled.member_types.get(sort)
        if model and r.model == model:
            self.insert(member_relation(model, sort), args[0], element)
        elif model and name.endswith("_mor_app"):
            self.insert(member_relation(model, sort), self.define(self.compiled.models[model].cod, args[0]), element)
        return element

    def equate(self, type_name: str, a: int, b: int) -> None:
        type_name = self.type_name(type_name)
        self.equalities.append((type_name, a, b))
        if self.engine.union_whole:
            self.engine.union.setdefault(type_name, components.UnionFind()).merge(a, b)

    def load(self, name: str, df: DataFrame, *columns: str) -> None:
        """Facts of a relation from a DataFrame of element ids, by position; its ids are elements from now on.

        A row with a null id is no fact.  In a member relation, elements of member types belong to the model
        element in front.
        """
        r = self.relation(name)
        columns = columns or tuple(df.columns)
        if len(columns) != r.width:
            raise ValueError(f"{r.name} takes {r.width} columns, not {len(columns)}")
        ids = df.select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(columns)])
        self.frames.append((r.name, ids.dropna() if columns else ids))

    def load_equal(self, type_name: str, df: DataFrame, left: str, right: str) -> None:
        """Equalities from a DataFrame of pairs of element ids."""
        type_name = self.type_name(type_name)
        pairs = df.select(F.lit(type_name).alias("tag"), F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).dropna()
        self.edge_frames.append(pairs)
        self.frames.append((type_name, pairs.select(F.inline(F.array(F.struct(F.col("a").alias("c0")), F.struct(F.col("b").alias("c0")))))))

    def elements_of(self, name: str, df: DataFrame) -> list[tuple[str, DataFrame]]:
        """Facts that others imply: the (type or membership, rows) that a relation's rows name, each row once."""
        r, out = self.relation(name), []
        for i, t in enumerate(r.columns[: len(df.columns)]):
            if r.kind != "type":
                out.append((t, df.select(F.col(f"c{i}").alias("c0"))))
            if i and r.model and r.kind != "member" and self.compiled.member_types.get(t) == r.model:
                out.append((member_relation(r.model, t), df.select("c0", F.col(f"c{i}").alias("c1"))))
        return [(n, rows.distinct()) for n, rows in out]

    def define_all(self, name: str, df: DataFrame, *columns: str, into: str = "value") -> DataFrame:
        """``df`` with the value of a function of its columns; what has none gets one made, each argument tuple once.

        A row with a null argument has a null value.  Equalities that are still to be merged are merged first.
        """
        r = self.relation(name, "func", "ctor")
        if r.columns[-1] in self.compiled.enums and r.kind != "ctor":
            raise ValueError(f"an element of {r.columns[-1]} comes from a constructor only")
        if r.width == 1:
            return df.withColumn(into, F.lit(self.define(r.name)).cast("long"))
        args = self.arguments(r, df, columns).dropna().distinct()
        rows = args.select(F.lit(r.name).alias("rel"), *args.columns, *[F.lit(0).cast("long").alias(f"c{i}") for i in range(r.width - 1, self.store.width)])
        if self.store.runs[r.name]:
            rows = rows.join(self.store.table(r.name).select(*args.columns), args.columns, "left_anti")
        member = self.compiled.member_types.get(r.columns[-1])
        if member and r.name.endswith("_mor_app"):
            self.define_all(self.compiled.models[member].cod, args, "c0")
        for n, of in self.elements_of(r.name, args):
            self.imply(n, of)
        same = [f"c{i}" for i, t in enumerate(r.columns[:-1]) if t == r.columns[-1]]
        if same:  # arguments that are seen for the first time: their ids are taken
            most = args.agg(F.max(F.greatest(*same) if len(same) > 1 else F.col(same[0]))).first()[0]
            self.engine.next_id[r.columns[-1]] = max(self.engine.next_id[r.columns[-1]], (most if most is not None else -1) + 1)
        self.engine.make(rows, [r.name])
        return self.eval_all(r.name, df, *columns, into=into)

    def imply(self, name: str, rows: DataFrame) -> None:
        if name in self.engine.listed:
            self.frames.append((name, rows))
        else:
            self.implied.add(name)
        self.engine.loaded |= {t for t in self.relation(name).columns}

    def arguments(self, r: Relation, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """Columns of ``df`` as roots, c0, c1, ... in the order of a relation's columns."""
        if r.kind in ("func", "ctor") and len(columns) != r.width - 1:
            raise ValueError(f"{r.name} takes {r.width - 1} arguments, not {len(columns)}")
        self.flush(merge=True)
        out = df.select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(columns)])
        for i in range(len(columns)):
            out = self.canonical(out, f"c{i}", r.columns[i])
        return out

    # Writing what is pending ----------------------------------------------------------------------
    def flush(self, merge: bool = False) -> None:
        """Writes pending facts; with ``merge`` also applies pending equalities to all tables."""
        store, frames = self.store, []
        if self.pending:
            width = store.width
            rooted = [(name, *self.roots(name, t)) for name, ts in self.pending.items() for t in ts]
            rows = [(*r, *[0] * (width + 1 - len(r))) for r in rooted]
            frames.append(self.spark.createDataFrame(rows, ", ".join(["rel string", *[f"c{i} bigint" for i in range(width)]])))
        loaded = list(self.frames)
        for name, df in self.frames:
            for n, rows in self.elements_of(name, df):
                if n in self.engine.listed:
                    loaded.append((n, rows))
                else:
                    self.implied.add(n)
            self.engine.loaded |= set(self.relation(name).columns)
        for name, df in loaded:
            frames.append(store.wide(name, df, store.columns(name) if self.relation(name).width else [], 0).drop("gen"))
        names = {*self.pending, *[n for n, _ in loaded]}
        self.pending, self.frames = {}, []
        parts = {}
        if frames:
            keys, size = ["rel", *[f"c{i}" for i in range(store.width)]], sum(scanned(df) for _, df in loaded)
            rows = self.engine.merged(frames)
            if size >= SETTLED_BYTES:  # else each scan's task makes its rows distinct, however many a row group of the file has
                rows = rows.repartition(*keys)
            rows = rows.dropDuplicates()
            known = [store.wide(n, store.table(n), store.columns(n), 0).drop("gen") for n in sorted(names) if store.runs[n]]
            if known:
                rows = rows.join(self.engine.merged(known), keys, "left_anti")
            self.engine.gen += 1
            with store.bounded(size):
                parts = store.write(rows.withColumn("gen", F.lit(self.engine.gen).cast("long")))
        edges = []
        if merge and self.equalities:
            edges.append(self.spark.createDataFrame(self.equalities, "tag string, a bigint, b bigint"))
        if merge:
            edges += self.edge_frames
            self.equalities, self.edge_frames = [], []
        if edges and not frames:
            self.engine.gen += 1
        if parts or edges:
            self.engine.apply(parts, self.engine.merged(edges) if edges else None)

    # Closing ------------------------------------------------------------------------------------
    def close(self, *, max_rounds: int | None = None, max_elements: int | None = None) -> Model:
        """All rules to their fixed point.  May not end for theories that always make new elements."""
        self.close_until(None, max_rounds=max_rounds, max_elements=max_elements)
        return self

    def close_until(self, done: Callable[[Model], bool] | None, *, max_rounds: int | None = None, max_elements: int | None = None) -> bool:
        """Closes until ``done(self)``; false if the fixed point came first.

        Order: pending facts and equalities are applied; ``done``; then rounds of (a) all rules on what there
        is, (b) new rows become old, (c) equalities are merged, (d) tables are rewritten to roots, (e) new
        tuples are inserted, inherited ones (f) with them, (g) ``done``, (h) if nothing is new, definitions.
        ``done`` is not asked between definitions and the next round.
        """
        self.flush(merge=True)
        return self.engine.close((lambda: done(self)) if done else None, max_rounds, max_elements)

    # Facts out ----------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """All tuples of a relation (a function's value last), columns c0, c1, ..."""
        name = self.relation(name).name
        self.flush()
        rows = self.store.table(name).drop("gen")
        if name not in self.implied:
            return rows
        # Elements that facts name, of a type whose table no rule reads.
        more = [of for r in self.compiled.relations if self.store.runs[r] for n, of in self.elements_of(r, self.store.table(r)) if n == name]
        return self.engine.merged([rows, *more]).distinct()

    def own(self, name: str) -> DataFrame:
        """Tuples of a member relation that no morphism brings."""
        name = self.relation(name).name
        rule = next(r for r in self.compiled.rules if r.name == f"inherit_{name}")
        self.flush()
        if any(not self.store.runs[a.relation] for a in rule.premise):
            return self.table(name)
        image = premise.join(self.spark, rule.premise, 0, lambda i: self.store.table(rule.premise[i].relation), rule.used())
        image = image.select(*[F.col(f"v{v}").alias(f"c{i}") for i, v in enumerate(rule.insert.vars)]).distinct()
        return self.table(name).join(image, self.store.columns(name), "left_anti")

    def elements(self, type_name: str) -> DataFrame:
        """Canonical elements of a type (column el)."""
        type_name = self.type_name(type_name)
        out = self.table(type_name).select(F.col("c0").alias("el"))
        merged = [x for t, a, b in self.equalities if t == type_name for x in (a, b) if self.root(t, x) != x]
        return out.where(~F.col("el").isin(merged)) if merged else out

    def holds(self, name: str, *args: int) -> bool:
        name = self.relation(name).name
        key = self.roots(name, args) or (0,)
        if len(args) != self.relation(name).width:
            raise ValueError(f"{name} takes {self.relation(name).width} elements")
        if any((self.roots(name, t) if args else t) == key for t in self.pending.get(name, ())):
            return True
        return self.find(name, key) is not None

    def eval(self, name: str, *args: int) -> int | None:
        r = self.relation(name, "func", "ctor")
        name = r.name
        if len(args) != r.width - 1:
            raise ValueError(f"{name} takes {r.width - 1} arguments")
        key = self.roots(name, args)
        for t in self.pending.get(name, ()):
            if self.roots(name, t)[:-1] == key:
                return self.roots(name, t)[-1]
        found = self.find(name, key)
        return self.root(r.columns[-1], found[r.width - 1]) if found is not None else None

    def find(self, name: str, key: tuple[int, ...]):
        if any(n == name for n, _ in self.frames):
            self.flush()
        if not self.store.runs[name] and name not in self.implied:
            return None
        rows = self.table(name) if name in self.implied else self.store.table(name)
        for i, v in enumerate(key):
            rows = rows.where(F.col(f"c{i}") == v)
        return rows.first()

    def eval_all(self, name: str, df: DataFrame, *columns: str, into: str = "value") -> DataFrame:
        """``df`` with the value of a function of its columns (roots of them); null where there is none."""
        r = self.relation(name, "func", "ctor")
        return self.looked_up(r, df, columns, F.col(f"_f{r.width - 1}"), into)

    def holds_all(self, name: str, df: DataFrame, *columns: str, into: str = "holds") -> DataFrame:
        """``df`` with whether a relation holds of its columns."""
        r = self.relation(name)
        if len(columns) != r.width:
            raise ValueError(f"{r.name} takes {r.width} elements")
        return self.looked_up(r, df, columns, F.col("_f0").isNotNull(), into)

    def looked_up(self, r: Relation, df: DataFrame, columns: tuple[str, ...], value, into: str) -> DataFrame:
        self.arguments(r, df, columns)  # checks, and merges what is to be merged
        rows = df.select("*", *[F.col(c).cast("long").alias(f"_a{i}") for i, c in enumerate(columns)])
        for i in range(len(columns)):
            rows = self.canonical(rows, f"_a{i}", r.columns[i])
        facts = self.table(r.name)
        # A function can have several values until it is closed; then the least one counts.
        keys = [f"c{i}" for i in range(len(columns))]
        if len(keys) < r.width:
            facts = facts.groupBy(*keys).agg(F.min(f"c{r.width - 1}").alias(f"c{r.width - 1}"))
        facts = facts.toDF(*[f"_f{c[1:]}" for c in facts.columns])
        on = [F.col(f"_a{i}") == F.col(f"_f{i}") for i in range(len(columns))]
        out = rows.join(facts, on, "left") if on else rows.join(facts, F.lit(True), "left")
        return out.select(*[F.col(c) for c in df.columns if c != into], value.alias(into))

    def all_cases(self, enum: str) -> DataFrame:
        """(el, case, args): every constructor and its arguments that make an element of an enum."""
        found = []
        for c in self.compiled.enums[self.type_name(enum)].ctors:
            n = self.relation(c).width - 1
            args = F.array(*[f"c{i}" for i in range(n)]) if n else F.array().cast("array<bigint>")
            found.append(self.table(c).select(F.col(f"c{n}").alias("el"), F.lit(c).alias("case"), args.alias("args")))
        return self.engine.merged(found)

    def cases(self, enum: str, element: int) -> list[tuple[str, tuple[int, ...]]]:
        """Constructors and arguments that make the element; there may be none, or several (``all_cases`` for very many)."""
        root = self.root(enum, element)
        order = {c: i for i, c in enumerate(self.compiled.enums[self.type_name(enum)].ctors)}
        found = self.all_cases(enum).where(F.col("el") == root).collect()
        return sorted(((r["case"], tuple(r["args"])) for r in found), key=lambda x: (order[x[0]], x[1]))

    def case(self, enum: str, element: int) -> tuple[str, tuple[int, ...]]:
        """The first of the cases, by constructor and arguments."""
        root = self.root(enum, element)
        for c in self.compiled.enums[self.type_name(enum)].ctors:
            n = self.relation(c).width - 1
            args = [f"c{i}" for i in range(n)]
            first = self.table(c).where(F.col(f"c{n}") == root).orderBy(f"c{n}", *args).first()
            if first:
                return c, tuple(first)[:n]
        raise LookupError(f"no constructor of {enum} makes {element}")

    def query(self, text: str, variables: list[str]) -> DataFrame:
        """Bindings of ``variables`` for all matches of premises (``if`` statements), as a DataFrame."""
        source = f"{self.theory.source}\nrule query_ {{\n{text}\n}}\n"
        c = Compiler(source, self.theory.name)
        decls = parse(c.source, c.name)
        c.resolve_names(decls)
        walk = Walk(c, None, decls[-1], "query_")
        try:
            paths = walk.block(decls[-1].body, [(Facts(), {})])
        except RuleError:
            paths = []
        if c.problems:
            raise TheoryError(min(c.problems, key=lambda p: p.rank()), source, self.theory.name)
        self.flush()
        found = []
        for facts, env in paths:
            missing = [v for v in variables if v not in env]
            if missing:
                raise KeyError(f"the query has no variable {missing[0]!r}")
            roots = [facts.root(env[v]) for v in variables]
            walk.pending = []
            for x in roots:
                walk.relate(facts, facts.type_of[x][0], (x,), True)
            walk.emit(facts, insert=None, equal=("", roots[0] if roots else 0, roots[0] if roots else 0))
            atoms = walk.pending[-1].premise
            if any(not self.store.runs[a.relation] and a.relation not in self.implied for a in atoms):
                continue
            rows = premise.join(self.spark, atoms, None, lambda i, atoms=atoms: self.table(atoms[i].relation), set(roots))
            found.append(rows.select(*[F.col(f"v{x}").alias(v) for v, x in zip(variables, roots, strict=True)]))
        if not found:
            return self.spark.createDataFrame([], ", ".join(f"{v} bigint" for v in variables))
        return self.settled(self.engine.merged(found).distinct())

    def settled(self, rows: DataFrame) -> DataFrame:
        """``rows``; where they come from much, they are computed now, in tasks of bounded size, and kept with the model."""
        size = scanned(rows)
        if size < SETTLED_BYTES:
            return rows
        path = f"{self.store.root}/settled-{uuid.uuid4().hex}"
        with self.store.bounded(size):
            rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def classes(self, type_name: str) -> DataFrame:
        """(el, root) for every element that is not its class's root, as of the last close."""
        type_name = self.type_name(type_name)
        return self.engine.roots_table(type_name)

    def canonical(self, df: DataFrame, column: str, type_name: str) -> DataFrame:
        """``df`` with a column of ids replaced by their roots."""
        type_name = self.type_name(type_name)
        if not self.engine.merges:
            return df
        roots = self.engine.roots_table(type_name).select(F.col("el").alias("_el"), F.col("root").alias("_root"))
        out = df.join(roots, F.col(column) == F.col("_el"), "left")
        return out.select(*[F.coalesce("_root", column).alias(c) if c == column else F.col(c) for c in df.columns])

    # State --------------------------------------------------------------------------------------
    def save(self) -> str:
        """Notes the state beside the tables, in one step; returns the folder to ``reopen``.

        What is pending is written and merged first.  Tables that the noted state needs are kept until the next note.
        """
        self.flush(merge=True)
        store, engine = self.store, self.engine
        state = {
            "source": self.theory.source, "name": self.theory.name, "allow_cycles": engine.allow_cycles,
            "runs": store.runs, "span": {p: store.span[p] for ps in store.runs.values() for p in ps}, "writes": store.writes,
            "stale": {p: store.stale[p] for ps in store.runs.values() for p in ps if p in store.stale},
            "gen": engine.gen, "seen": engine.seen, "defined": engine.defined, "rounds": engine.rounds, "ran_empty": engine.ran_empty,
            "delta": sorted(engine.delta), "delta_defined": sorted(engine.delta_defined), "next_id": engine.next_id, "loaded": sorted(engine.loaded),
            "merges": engine.merges, "implied": sorted(self.implied), "key_files": self.key_files,
        }
        store.write_text("state.json", json.dumps(state))
        store.saved = {p[len(store.root) + 1 :].split("/", 1)[0] for ps in store.runs.values() for p in ps}
        return store.root

    def drop(self) -> None:
        """Deletes the model's tables."""
        self.store.drop()


def reopen(spark: SparkSession, folder: str) -> Model:
    """The model that was saved in a folder, as it was then."""
    state = json.loads(spark.read.text(f"{folder}/state.json", wholetext=True).first()[0])
    m = Model(spark, Theory(state["source"], state["name"]), allow_cycles=state["allow_cycles"], path=folder)
    store, engine = m.store, m.engine
    store.runs, store.span, store.stale, store.writes = state["runs"], {p: tuple(s) for p, s in state["span"].items()}, state["stale"], state["writes"]
    engine.gen, engine.seen, engine.defined, engine.rounds, engine.ran_empty = (state[k] for k in ("gen", "seen", "defined", "rounds", "ran_empty"))
    engine.delta, engine.delta_defined, engine.loaded = set(state["delta"]), set(state["delta_defined"]), set(state["loaded"])
    engine.next_id, m.implied = state["next_id"], set(state["implied"])
    # Writes after the note belong to no state; their names are not to be used again.
    taken = [int(n.rsplit("-", 1)[1]) for n in store.names() if n.rsplit("-", 1)[-1].isdigit()]
    store.writes, engine.gen = max([store.writes, *taken]), max([engine.gen, *taken])
    engine.reload_merges(state["merges"])
    for t, (files, schema) in state["key_files"].items():
        m.key_files[t] = (files, schema)
        m.dictionaries[t] = spark.read.schema(schema).parquet(*files)
    store.saved = {p[len(store.root) + 1 :].split("/", 1)[0] for ps in store.runs.values() for p in ps}
    return m


__all__ = ["Model", "Theory", "load_theories", "load_theory", "reopen"]
