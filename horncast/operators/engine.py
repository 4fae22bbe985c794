"""The fixed-point engine: semi-naive rounds, equality, restricted definitions.

A round evaluates every rule that can see something new, in one job: each premise atom in turn ranges over
the last round's rows, atoms before it over all rows, atoms after it over the older ones.  All conclusions
go into one table, tagged by relation, are made distinct, compared with what is known, and written by
relation.  Equalities (asserted, or due to a function with two values for the same arguments) are merged to
classes, and rows that hold a merged element are rewritten to roots; rewritten rows count as new.  Small
relations are written anew for that; of large ones only the rows touched are, beside a note that the old rows
are void (see ``store``).  When a round brings nothing, definitions are applied: for each argument tuple without a value a fresh
element is made.  The order of steps is that of ``close_until``'s docstring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.errors import MorphismCycleError
from ..plans.ir import Atom, FlatRule, apply_relation, member_relation
from . import components, premise
from .store import Store

#: Bytes of files: more is much to move for an anti join; less (compressed) is few enough to broadcast.
MUCH_BYTES, FEW_BYTES = 256 << 20, 4 << 20
#: Merged elements that are broadcast to large relations; steps between compactions of what is merged; notes a run may carry.
FEW_MERGED, MERGE_STEPS, MOST_STALE = 200_000, 8, 6
EQ = "="  # tag of equalities, before the type's name


class LimitExceeded(RuntimeError):
    """Rounds or elements went beyond the limit that the caller set."""


class Engine:
    def __init__(self, store: Store, allow_cycles: bool = False):
        self.store, self.theory, self.spark = store, store.theory, store.spark
        self.allow_cycles = allow_cycles
        self.gen = 0  # number of the last write that brought rows
        self.seen = 0  # rows up to this number have been through the rules
        self.defined = 0  # rows up to this number have been through the definitions
        self.delta: set[str] = set()  # relations with rows after ``seen``
        self.delta_defined: set[str] = set()  # and after ``defined``
        self.ran_empty = False
        self.next_id = {name: 0 for name, r in self.theory.relations.items() if r.kind == "type"}
        self.merges: list[str] = []  # tables (tag, el, root), in order
        self.loaded: set[str] = set()  # types of which ids came from outside since ``next_id`` was last right
        self.union: dict[str, components.UnionFind] = {}
        self.union_whole = True  # whether ``union`` has every merge
        self.rounds = 0
        self.keyed: dict[tuple, bool] = {}  # whether columns of a relation determine its rows, by runs
        self.plain = [r for r in self.theory.rules if not r.define]
        self.makers = [r for r in self.theory.rules if r.define]
        self.derived = {(r.insert or r.define).relation for r in self.theory.rules if r.insert or r.define}
        #: type and membership tables that rules read
        self.listed = {a.relation for r in self.theory.rules for a in r.premise if self.theory.relation(a.relation).kind in ("type", "member")}

    # Tables -------------------------------------------------------------------------------------
    def all_rows(self, relation: str) -> DataFrame:
        return self.store.table(relation)

    def merged(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    # One round ----------------------------------------------------------------------------------
    def variants(self, rule: FlatRule, since: int, delta: set[str]) -> list[DataFrame]:
        """Bindings of a rule's premise that use at least one row after ``since``."""
        out = []
        needed = rule.used()
        for i, atom in enumerate(rule.premise):
            if atom.relation not in delta:
                continue

            def table(j: int, i: int = i) -> DataFrame:
                name = rule.premise[j].relation
                if j == i:
                    return self.store.table(name, after=since)
                if j < i:
                    return self.store.table(name)
                return self.store.table(name, until=since)

            # A table without a run makes the variant empty.
            if any(not self.store.within(a.relation, -1, since if j > i else float("inf")) for j, a in enumerate(rule.premise) if j != i):
                continue

            def size(j: int, i: int = i) -> int:
                return self.store.bytes(self.store.within(rule.premise[j].relation, since if j == i else -1, since if j > i else float("inf")))

            out.append(premise.join(self.spark, rule.premise, i, table, needed, size))
        return out

    def one_to_one(self, rule: FlatRule) -> bool:
        """Whether different matches of a rule are known to give different tuples, so that these need no ``distinct``.

        They do if the conclusion's variables determine all others.  Which columns of a small relation that no
        rule derives determine the others is counted, where very many matches are possible.
        """
        bound = set(rule.used())
        many = premise.most_matches([self.store.bytes(self.store.runs[a.relation]) for a in rule.premise]) > premise.MANY_ROWS
        while rest := [a for a in rule.premise if not set(a.vars) <= bound]:
            found = next((a for a in rest if many and self.determines(a, bound)), None)
            if found is None:
                return False
            bound |= set(found.vars)
        return True

    def determines(self, atom: Atom, bound: set[int]) -> bool:
        name, cols = atom.relation, tuple(f"c{i}" for i, v in enumerate(atom.vars) if v in bound)
        runs = tuple(self.store.runs[name])
        if not cols or name in self.derived or self.store.bytes(list(runs)) > FEW_BYTES:
            return False
        at = (name, cols, runs, tuple(tuple(self.store.stale.get(p, ())) for p in runs))
        if at not in self.keyed:
            self.keyed[at] = self.store.table(name).groupBy(*cols).count().where("count > 1").isEmpty()
        return self.keyed[at]

    def conclusions(self) -> list[tuple[str, FlatRule | str | None, DataFrame]]:
        """Tagged rows, their tag, and the rule (or function) that they come from if they are all different (or few differ)."""
        found = []
        for rule in self.plain:
            if not rule.premise:
                bindings = [] if self.ran_empty else [premise.join(self.spark, (), None, None, set())]
            else:
                bindings = self.variants(rule, self.seen, self.delta)
            for b in bindings:
                if rule.insert:
                    sole = rule if rule.premise and self.one_to_one(rule) else None
                    found.append((rule.insert.relation, sole, self.tagged(rule.insert.relation, b, rule.insert.vars)))
                else:
                    t, left, right = rule.equal
                    found.append((EQ + t, None, self.tagged(EQ + t, b.where(F.col(f"v{left}") != F.col(f"v{right}")), (left, right))))
        for name in sorted(self.delta):
            if self.theory.relation(name).is_function:
                found.append((EQ + self.theory.relation(name).columns[-1], name, self.functionality(name)))
        return found

    def tagged(self, tag: str, bindings: DataFrame, variables: tuple[int, ...]) -> DataFrame:
        cols = [F.col(f"v{v}").alias(f"c{i}") for i, v in enumerate(variables)]
        cols += [F.lit(0).cast("long").alias(f"c{i}") for i in range(len(variables), self.store.width)]
        return bindings.select(F.lit(tag).alias("rel"), *cols)

    def functionality(self, name: str) -> DataFrame:
        """Two values for the same arguments are equal: an edge from each to the least."""
        r = self.theory.relation(name)
        args, value = [f"c{i}" for i in range(r.width - 1)], f"c{r.width - 1}"
        new = self.store.table(name, after=self.seen)
        rows = self.store.table(name).select(*args, value)
        if args:
            if any(self.store.span[p][0] <= self.seen for p in self.store.runs[name]):  # else all rows are new
                rows = rows.join(new.select(*args).distinct(), args, "left_semi")
            least = rows.groupBy(*args).agg(F.min(value).alias("m"), F.max(value).alias("x")).where("m != x").drop("x")
            edges = rows.join(least, args)
        else:
            edges = rows.crossJoin(rows.agg(F.min(value).alias("m")))
        pairs = edges.where(F.col(value) != F.col("m")).select(F.col(value).alias("v0"), F.col("m").alias("v1"))
        return self.tagged(EQ + r.columns[-1], pairs, (0, 1))

    def rules_round(self) -> tuple[dict[str, str], dict[str, str]]:
        """Runs the rules; folders of the new tuples and of the equalities."""
        with self.store.bounded():
            found = self.conclusions()
            self.ran_empty = True
            if not found:
                return {}, {}
            parts = self.written(found)
        return {k: v for k, v in parts.items() if not k.startswith(EQ)}, {k[1:]: v for k, v in parts.items() if k.startswith(EQ)}

    def written(self, found: list[tuple[str, FlatRule | str | None, DataFrame]]) -> dict[str, str]:
        """Writes what is new of conclusions; the folder of each tag that has rows.

        Only relations with rows are compared with what is known, which moves all that is known of them.  Where
        that is much, the conclusions are written first, to see which these are; where they are few, they are
        broadcast to find those that are known.
        """
        sources: dict[str, list[FlatRule | str | None]] = {}
        for tag, rule, _ in found:
            sources.setdefault(tag, []).append(rule)
        # Variants of one rule share no match.  Edges of functions are no more than their rows, and may repeat.
        apart = {tag for tag, rules in sources.items() if rules[0] is not None and all(r is rules[0] or isinstance(r, str) for r in rules)}
        old = sorted(t for t in sources if not t.startswith(EQ) and self.store.runs[t])
        much = self.store.bytes([p for t in old for p in self.store.runs[t]]) >= MUCH_BYTES

        def rows_of(tags: set[str]) -> list[DataFrame]:
            repeated = [rows for tag, _, rows in found if tag in tags - apart]
            out = [rows for tag, _, rows in found if tag in tags & apart]
            return out + ([self.merged(repeated).dropDuplicates()] if repeated else [])

        frames = rows_of(set(sources) if much else set(sources) - set(old))
        if old and not much:
            frames.append(self.unknown(self.merged(rows_of(set(old))), self.known_rows(old)))
        gen = F.lit(self.gen + 1).cast("long")
        parts = self.store.write(self.merged(frames).withColumn("gen", gen))
        met = [t for t in old if t in parts] if much else []
        if not met:
            return parts
        rows = self.merged([self.store.wide(t, self.spark.read.schema(self.store.schema(t)).parquet(parts[t]), self.store.columns(t), 0).drop("gen") for t in met])
        new = self.unknown(rows, self.known_rows(met), self.store.bytes([parts[t] for t in met]) <= FEW_BYTES)
        return {t: p for t, p in parts.items() if t not in met} | self.store.write(new.withColumn("gen", gen))

    def known_rows(self, names: list[str]) -> DataFrame:
        return self.merged([self.store.wide(n, self.store.table(n), self.store.columns(n), 0).drop("gen") for n in names])

    def unknown(self, rows: DataFrame, known: DataFrame, few: bool = False) -> DataFrame:
        """Rows that are not known yet; with ``few``, they are broadcast, and only those that are known are taken away."""
        keys = ["rel", *[f"c{i}" for i in range(self.store.width)]]
        if not few:
            return rows.join(known, keys, "left_anti")
        return rows.join(known.join(F.broadcast(rows), keys, "left_semi"), keys, "left_anti")

    def settled(self, rows: DataFrame) -> tuple[DataFrame, bool]:
        """Rows as written, and whether they are few."""
        self.store.writes += 1
        path = f"{self.store.root}/write-{self.store.writes:05d}"
        rows.write.parquet(path)
        self.store.live.add(path.rsplit("/", 1)[1])
        return self.spark.read.schema(rows.schema).parquet(path), self.store.bytes([path]) <= FEW_BYTES

    def take(self, tuples: dict[str, str], equal: dict[str, str]) -> None:
        """Steps (b) to (f) of a round: what was new is old; merge, rewrite, insert."""
        self.seen, before = self.gen, self.gen
        self.delta = set()
        if not tuples and not equal:
            return
        self.gen = before + 1
        edges = [self.spark.read.schema("c0 bigint, c1 bigint").parquet(p).select(F.lit(t).alias("tag"), F.col("c0").alias("a"), F.col("c1").alias("b")) for t, p in equal.items()]
        self.apply(tuples, self.merged(edges) if edges else None)

    def apply(self, tuples: dict[str, str], edges: DataFrame | None) -> None:
        """Inserts rows of folders ``tuples`` (gen = self.gen), after merging along ``edges``."""
        with self.store.bounded():
            changed = components.roots(edges) if edges is not None else None
            self.merge_all(tuples, changed)

    def merge_all(self, tuples: dict[str, str], changed: DataFrame | None) -> None:
        if changed is None:
            for name, path in tuples.items():
                self.store.add(name, path, self.gen, self.gen)
            self.note(set(tuples))
            return
        types = {r["tag"] for r in changed.select("tag").distinct().collect()}
        if not types:
            self.apply(tuples, None)
            return
        path = f"{self.store.root}/merge-{self.gen:05d}"
        changed.write.parquet(path)
        changed = self.merge_table(path)
        self.remember(path)
        touched = [n for n, r in self.theory.relations.items() if types & set(r.columns) and (self.store.runs[n] or n in tuples)]
        large = [n for n in touched if self.store.bytes(self.store.runs[n]) >= MUCH_BYTES]
        if large and changed.limit(FEW_MERGED + 1).count() > FEW_MERGED:
            large = []
        moved = self.rewrite([n for n in touched if n not in large], tuples, changed, types)
        moved |= self.replace(large, tuples, changed, types, path)
        for name, folder in tuples.items():
            if name not in touched:
                self.store.add(name, folder, self.gen, self.gen)
        self.note(moved | (set(tuples) - set(touched)))

    def merge_table(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("tag string, el bigint, root bigint").parquet(*paths)

    def rooted(self, name: str, rows: DataFrame, changed: DataFrame, types: set[str], small: bool) -> DataFrame:
        """``rows`` with merged elements replaced by their roots, and ``moved``, whether there were any."""
        r, moved = self.theory.relation(name), F.lit(False)
        for i, t in enumerate(r.columns):
            if t in types:
                to = changed.where(F.col("tag") == t).select(F.col("el").alias(f"_e{i}"), F.col("root").alias(f"_r{i}"))
                rows = rows.join(F.broadcast(to) if small else to, F.col(f"c{i}") == F.col(f"_e{i}"), "left")
                moved = moved | F.col(f"_r{i}").isNotNull()
        cols = [F.coalesce(f"_r{i}", c).alias(c) if i < r.width and r.columns[i] in types else F.col(c) for i, c in enumerate(self.store.columns(name))]
        return rows.select(*cols, "gen", moved.alias("moved"))

    def replace(self, names: list[str], tuples: dict[str, str], changed: DataFrame, types: set[str], merge: str) -> set[str]:
        """Large relations: only the rows that hold a merged element are written, over roots; the old ones become void."""
        if not names:
            return set()
        keys = ["rel", *[f"c{i}" for i in range(self.store.width)]]
        hit = []
        for name in names:
            cols = self.store.columns(name)
            hit.append(self.store.wide(name, self.rooted(name, self.store.table(name), changed, types, True).where("moved"), cols, 0))
            if name in tuples:
                new = self.spark.read.schema(self.store.schema(name)).parquet(tuples[name])
                hit.append(self.store.wide(name, self.rooted(name, new, changed, types, True), cols, 0))
        rows = self.merged(hit).select(*keys).distinct()
        old_runs = {n: list(self.store.runs[n]) for n in names}
        for name in names:
            for p in old_runs[name]:
                self.store.stale[p] = [*self.store.stale.get(p, []), merge]
        known = self.known_rows(names)
        few = False
        if self.store.bytes([p for n in names for p in old_runs[n]]) >= MUCH_BYTES:
            rows, few = self.settled(rows)
        parts = self.store.write(self.unknown(rows, known, few).withColumn("gen", F.lit(self.gen).cast("long")))
        for name, path in parts.items():
            self.store.add(name, path, self.gen, self.gen)
        for name in names:
            if any(len(self.store.stale.get(p, ())) > MOST_STALE for p in self.store.runs[name]):
                self.join_runs([name])
        return set(parts)

    def rewrite(self, touched: list[str], tuples: dict[str, str], changed: DataFrame, types: set[str]) -> set[str]:
        """Writes the relations ``touched`` anew over roots; those that have rows of this write."""
        if not touched:
            return set()
        frames = []
        for name in touched:
            rows = self.store.table(name)
            if name in tuples:
                rows = rows.unionByName(self.spark.read.schema(self.store.schema(name)).parquet(tuples[name]))
            rows = self.rooted(name, rows, changed, types, False)
            gen = F.when(F.col("moved"), F.lit(self.gen)).otherwise(F.col("gen")).cast("long").alias("gen")
            frames.append(self.store.wide(name, rows, self.store.columns(name), gen))
        cols = [f"c{i}" for i in range(self.store.width)]
        # Where a rewritten row meets one that was there, the older stays and is not derived from again.
        whole = self.merged(frames).groupBy("rel", *cols).agg(F.min("gen").alias("gen"))
        whole = whole.withColumn("fresh", F.col("gen") == self.gen)
        self.store.writes += 1
        path = f"{self.store.root}/write-{self.store.writes:05d}"
        whole.write.partitionBy("fresh", "rel").parquet(path)
        new = self.store.parts(f"{path}/fresh=true")
        old = self.store.parts(f"{path}/fresh=false")
        for name in touched:
            self.store.runs[name] = []
            if name in old:
                self.store.add(name, old[name], 0, self.gen - 1)
            if name in new:
                self.store.add(name, new[name], self.gen, self.gen)
        return set(new)

    def note(self, names: set[str]) -> None:
        self.delta |= names
        self.delta_defined |= names

    def reload_merges(self, paths: list[str]) -> None:
        """Merges of a saved state."""
        self.merges, self.union, self.union_whole = [], {}, True
        for p in paths:
            self.remember(p)

    def remember(self, path: str) -> None:
        changed = self.merge_table(path)
        self.merges.append(path)
        few = changed.limit(components.DRIVER_EDGES + 1).collect() if self.union_whole else []
        if len(few) > components.DRIVER_EDGES:
            self.union_whole, self.union = False, {}
        for tag, el, root in few if self.union_whole else []:
            self.union.setdefault(tag, components.UnionFind()).merge(el, root)
        if len(self.merges) >= MERGE_STEPS:
            whole = f"{self.store.root}/roots-{self.gen:05d}"
            self.all_roots().write.parquet(whole)
            self.merges = [whole]

    def all_roots(self) -> DataFrame:
        """(tag, el, root) of all elements that are not their own root: at most ``MERGE_STEPS`` steps, one after the other."""
        out: DataFrame | None = None
        for path in self.merges:
            step = self.merge_table(path)
            if out is None:
                out = step
            else:
                on = step.select(F.col("tag").alias("_tag"), F.col("el").alias("_el"), F.col("root").alias("_root"))
                out = out.join(on, (F.col("tag") == F.col("_tag")) & (F.col("root") == F.col("_el")), "left")
                out = out.select("tag", "el", F.coalesce("_root", "root").alias("root")).unionByName(step)
        return out if out is not None else self.spark.createDataFrame([], "tag string, el bigint, root bigint")

    def roots_table(self, type_name: str) -> DataFrame:
        """(el, root) of all elements of a type that are not their own root."""
        return self.all_roots().where(F.col("tag") == type_name).select("el", "root")

    # Ids ------------------------------------------------------------------------------------------
    def raise_ids(self, types: set[str]) -> None:
        """Ids of these types that came from outside are below ``next_id``: one aggregation over the tables that have them."""
        todo, frames = types & self.loaded, []
        if not todo:
            return
        for name, r in self.theory.relations.items():
            mine = [i for i, t in enumerate(r.columns) if t in todo]
            if mine and self.store.runs[name]:
                pairs = F.array(*[F.struct(F.lit(r.columns[i]).alias("t"), F.col(f"c{i}").alias("x")) for i in mine])
                frames.append(self.spark.read.schema(self.store.schema(name)).parquet(*self.store.runs[name]).select(F.inline(pairs)))
        frames += [self.merge_table(p).where(F.col("tag").isin(*sorted(todo))).select(F.col("tag").alias("t"), F.col("el").alias("x")) for p in self.merges]
        if frames:
            for t, x in self.merged(frames).groupBy("t").agg(F.max("x")).collect():
                self.next_id[t] = max(self.next_id[t], x + 1)
        self.loaded -= todo

    # Definitions --------------------------------------------------------------------------------
    def define_round(self) -> bool:
        """Makes an element for every argument tuple that has no value; whether there was any."""
        found = []
        for rule in self.makers:
            if not rule.premise:
                bindings = [premise.join(self.spark, (), None, None, set())]
            else:
                bindings = self.variants(rule, self.defined, self.delta_defined)
            found += [self.tagged(rule.define.relation, b, rule.define.vars) for b in bindings]
        # Membership of an image needs the morphism's codomain, which is made on demand.
        self.defined, self.delta_defined = self.gen, set()
        if not found:
            return False
        rows = self.merged(found).dropDuplicates()
        cols = [f"c{i}" for i in range(self.store.width)]
        targets = sorted({r.define.relation for r in self.makers})
        known = []
        for t in targets:
            if self.store.runs[t]:
                args = self.store.columns(t)[: self.theory.relation(t).width - 1]
                known.append(self.store.wide(t, self.store.table(t), args, 0).drop("gen"))
        if known:
            rows = rows.join(self.merged(known), ["rel", *cols], "left_anti")
        return self.make(rows, sorted({m.define.relation for m in self.makers}))

    def make(self, rows: DataFrame, functions: list[str]) -> bool:
        """New elements for (rel, arguments); ids follow on: a row's place in its partition, after all partitions before."""
        self.raise_ids({self.theory.relation(f).columns[-1] for f in functions})
        self.store.writes += 1
        path = f"{self.store.root}/write-{self.store.writes:05d}"
        self.store.live.add(path.rsplit("/", 1)[1])
        rows.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
        schema = ", ".join(["rel string", *[f"c{i} bigint" for i in range(self.store.width)], "at bigint"])
        stored = self.spark.read.schema(schema).parquet(path).withColumn("part", F.shiftright("at", 33))
        sort_of = F.create_map(*[F.lit(x) for f in functions for x in (f, self.theory.relation(f).columns[-1])])
        stored = stored.withColumn("sort", sort_of[F.col("rel")])
        counts = {(r["sort"], r["part"]): (r["lo"], r["n"]) for r in stored.groupBy("sort", "part").agg(F.min("at").alias("lo"), (F.max("at") - F.min("at") + 1).alias("n")).collect()}
        if not counts:
            self.store.live.discard(path.rsplit("/", 1)[1])
            return False
        rows_of, base = [], dict(self.next_id)
        for (sort, part), (lo, n) in sorted(counts.items()):
            rows_of.append((sort, part, base[sort] - lo))
            base[sort] += n
        self.next_id = base
        shift = self.spark.createDataFrame(rows_of, "sort string, part bigint, shift bigint")
        placed = stored.join(F.broadcast(shift), ["sort", "part"]).withColumn("el", F.col("at") + F.col("shift"))
        self.gen += 1
        frames = []
        for f in functions:
            r = self.theory.relation(f)
            mine = placed.where(F.col("rel") == r.name)
            args, sort = [f"c{i}" for i in range(r.width - 1)], r.columns[-1]
            frames.append(self.store.wide(r.name, mine.select(*args, F.col("el").alias(f"c{r.width - 1}")), self.store.columns(r.name), self.gen))
            frames.append(self.store.wide(sort, mine.select(F.col("el").alias("c0")), ["c0"], self.gen))
            model = self.theory.member_types.get(sort)
            if model and r.model == model:
                frames.append(self.store.wide(member_relation(model, sort), mine.select("c0", F.col("el").alias("c1")), ["c0", "c1"], self.gen))
            elif model and r.name == apply_relation(sort):
                cod = self.theory.models[model].cod
                of = self.store.table(cod).select(F.col("c0").alias("f"), F.col("c1").alias("m"))
                image = mine.join(of, F.col("c0") == F.col("f")).select(F.col("m").alias("c0"), F.col("el").alias("c1"))
                frames.append(self.store.wide(member_relation(model, sort), image, ["c0", "c1"], self.gen))
        parts = self.store.write(self.merged(frames))
        self.store.live.discard(path.rsplit("/", 1)[1])
        self.apply(parts, None)
        return True

    # Closing ------------------------------------------------------------------------------------
    def close(self, done: Callable[[], bool] | None, max_rounds: int | None, max_elements: int | None) -> bool:
        self.check_cycles()
        if done and done():
            return True
        before = self.rounds
        while True:
            self.rounds += 1
            if max_rounds is not None and self.rounds - before > max_rounds:
                raise LimitExceeded(f"no fixed point after {max_rounds} rounds")
            self.take(*self.rules_round())
            self.check_cycles()
            if done and done():
                return True
            if not self.delta:
                if max_elements is not None and sum(self.next_id.values()) > max_elements:
                    raise LimitExceeded(f"more than {max_elements} elements")
                self.seen = self.gen
                if not self.define_round():
                    self.store.collect_garbage()
                    return False
            self.store.live.clear()
            if self.rounds % 8 == 0:
                self.compact()

    def compact(self) -> None:
        """Joins the many runs of a relation into one, so that a table stays a scan of few files."""
        many = [n for n, runs in self.store.runs.items() if len(runs) > 8]
        if many:
            self.join_runs(many)
        self.store.collect_garbage()

    def join_runs(self, names: list[str]) -> None:
        frames = [self.store.wide(n, self.store.table(n), self.store.columns(n), F.col("gen")) for n in names]
        parts = self.store.write(self.merged(frames))
        for n in names:
            self.store.runs[n] = []
            if n in parts:
                self.store.add(n, parts[n], 0, self.gen)

    def check_cycles(self) -> None:
        """A cycle of morphisms between model elements is an error, unless cycles are allowed."""
        if self.allow_cycles:
            return
        for m in self.theory.models.values():
            if not ({m.dom, m.cod} & self.delta) or not self.store.runs[m.dom] or not self.store.runs[m.cod]:
                continue
            arrows = self.store.table(m.dom).select("c0", F.col("c1").alias("a")).join(self.store.table(m.cod).select("c0", F.col("c1").alias("b")), "c0")
            edges = arrows.select("a", "b").distinct()
            few = [tuple(r) for r in edges.limit(components.DRIVER_EDGES + 1).collect()]
            if has_cycle(few) if len(few) <= components.DRIVER_EDGES else self.many_have_cycle(edges):
                raise MorphismCycleError(f"morphisms of {m.name} form a cycle")

    def many_have_cycle(self, edges: DataFrame) -> bool:
        """Peels elements without an incoming arrow; what cannot be peeled is on a cycle or behind one.

        Each job peels ``PEEL_LAYERS`` layers, so it takes as many jobs as the longest chain has such runs.
        """
        count = edges.count()
        while count:
            for _ in range(PEEL_LAYERS):
                edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            path = f"{self.store.root}/arrows-{self.store.writes:05d}"
            self.store.writes += 1
            edges.write.parquet(path)
            edges = self.spark.read.schema("a bigint, b bigint").parquet(path)
            left = edges.count()
            if left == count:
                return True
            count = left
        return False


#: Layers that one job peels: their joins double with each.
PEEL_LAYERS = 2


def has_cycle(edges: list[tuple[int, int]]) -> bool:
    """Whether few arrows form a cycle, by taking away elements without an incoming one."""
    after: dict[int, list[int]] = {}
    incoming: dict[int, int] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        incoming[b] = incoming.get(b, 0) + 1
    free, gone = [a for a in after if a not in incoming], 0
    while free:
        for b in after.get(free.pop(), ()):
            gone += 1
            incoming[b] -= 1
            if not incoming[b]:
                free.append(b)
    return gone < len(edges)
