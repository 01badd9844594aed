"""A repository's call graph across files: names, types and inherited members resolved by joins, to fixpoints.

Input are the facts of ``sources.parsers.repo_facts``. A chain such as ``self.store.save`` is walked one part a round,
all chains of the repository at once: the first part is the own class, a local variable, an import, a name of the module
or one that stands once in the repository; each later part is an attribute of the class reached so far (its own, the
nearest ancestor's, or the only one among its descendants), or extends a module's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.operators.graph import kept

# What a call's name or receiver speaks of.
DB_WRITE_CALL_HINTS = ("save", "persist", "upsert", "merge", "patch", "write", "create", "create_node", "create_relationship", "merge_relationship", "execute_query", "execute_write", "write_transaction", "run", "executemany", "bulk_write")
REPOSITORY_ADAPTER_HINTS = ("repo", "repository", "dao", "store", "adapter")
DRIVER_ADAPTER_HINTS = ("driver", "session", "tx", "transaction", "neo4j", "graph", "client")
TRANSACTION_HINTS = ("session", "transaction", "tx", "execute_write", "write_transaction", "begin_transaction")
RETRY_HINTS = ("retry", "backoff", "tenacity")
BATCH_HINTS = ("batch", "bulk", "chunk", "chunks", "records", "items", "executemany")

_LAST = lambda c: F.substring_index(c, ".", -1)
_FRONT = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")


class Repository:
    """The tables that resolution joins, each written once: what bare names mean in a module (``imports``, ``own``, ``only``),
    what imported names stand for (``exports``), bases (``arcs``), the methods and attributes that classes define
    (``methods``, ``attributes``) and the classes that functions return (``returns``). Inherited members are looked up for
    the classes and names that are asked for, as those of all classes would be the square of a tree's depth."""

    def __init__(self, facts: DataFrame):
        self.facts = kept(facts)
        of = lambda kind: self.facts.where(F.col("kind") == kind)
        interface = of("interface").select(F.col("name").alias("symbol")).distinct().withColumn("interface", F.lit(True))
        classes = of("class").select(F.col("name").alias("symbol"), "module").dropDuplicates(["symbol"])
        self.classes = kept(classes.join(interface, "symbol", "left").withColumn("interface", F.coalesce("interface", F.lit(False))))
        self.functions = kept(of("function").select(F.col("name").alias("symbol"), F.col("scope").alias("class"), "module").dropDuplicates(["symbol"]))
        self.imports = kept(of("import").groupBy("module", F.col("name").alias("head")).agg(F.max_by("target", "line").alias("imported")))
        top = self.classes.select("module", "symbol").union(self.functions.where("class = ''").select("module", "symbol")).where(_FRONT(F.col("symbol")) == F.col("module"))
        self.own = kept(top.groupBy("module", _LAST(F.col("symbol")).alias("head")).agg(F.min("symbol").alias("own")))
        names = self.classes.select("symbol", F.lit(0).alias("later")).union(self.functions.select("symbol", F.lit(1).alias("later"))).groupBy(_LAST(F.col("symbol")).alias("head"), "later").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
        self.only = kept(names.where("n = 1").groupBy("head").agg(F.min_by("symbol", "later").alias("only")))
        self.exports = self.passed_on()
        bases = of("base").select(F.col("name").alias("class"), "module", "target", F.col("line").alias("position"))
        self.arcs = kept(self.typed(bases).select("class", F.col("type").alias("base"), "position").distinct())
        self.methods = kept(self.functions.where("class <> ''").select("class", _LAST(F.col("symbol")).alias("name"), F.col("symbol").alias("target")))
        self.returns = kept(self.typed(of("returns").where("target <> ''").select(F.col("name").alias("callee"), "module", "target")).groupBy("callee").agg(F.min("type").alias("result")))
        bound = kept(of("attribute").select(F.col("scope").alias("class"), "name", "module", "target", "line", F.lit("").alias("scope")))
        self.attributes: DataFrame | None = None
        while True:  # an attribute may be bound to another one's attribute
            found = kept(self.walked(bound).where("type IS NOT NULL").groupBy("class", "name").agg(F.min_by("type", "line").alias("target")))
            if self.attributes is not None and found.exceptAll(self.attributes).isEmpty():
                break
            first, self.attributes = self.attributes is None, found
            later = bound.select(F.explode(F.slice(F.split("target", r"\."), 2, 1_000_000)).alias("part")).select(F.regexp_replace("part", r"\(\)$", "").alias("name"))
            if first and later.join(found.select("name").distinct(), "name", "left_semi").isEmpty():
                break  # no binding names an attribute

    def passed_on(self) -> DataFrame:
        """(alias, symbol): names that a module only imports, with what they stand for, however often they were passed on.
        Each round doubles the steps; names that are passed around in a circle stay unresolved."""
        out = kept(self.imports.select(F.concat_ws(".", "module", "head").alias("alias"), F.col("imported").alias("symbol")).where("alias <> symbol"))
        for _ in range(20):
            step = out.join(out.select(F.col("alias").alias("symbol"), F.col("symbol").alias("next")), "symbol", "left")
            if step.where("next IS NOT NULL").isEmpty():
                break
            out = kept(step.select("alias", F.coalesce("next", "symbol").alias("symbol")))
        return out

    def rooted(self, rows: DataFrame) -> DataFrame:
        """Rows (module, head) with the symbol that a bare name stands for in its module, or null."""
        out = rows.join(self.imports, ["module", "head"], "left").join(self.own, ["module", "head"], "left").join(self.only, "head", "left")
        return out.withColumn("root", F.coalesce("imported", "own", "only")).drop("imported", "own", "only")

    def final(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose symbol in ``column`` gives way to what it stands for, where it is an imported name."""
        return rows.join(self.exports.select(F.col("alias").alias(column), F.col("symbol").alias("_next")), column, "left").withColumn(column, F.coalesce("_next", column)).drop("_next")

    def typed(self, rows: DataFrame) -> DataFrame:
        """Those rows (module, target: a dotted name) that name a class, with it as ``type``."""
        rooted = self.rooted(rows.withColumn("head", F.substring_index("target", ".", 1)))
        named = rooted.withColumn("type", F.concat(F.col("root"), F.substr("target", F.length("head") + 1))).drop("head", "root")
        return self.final(named, "type").join(self.classes.select(F.col("symbol").alias("type")), "type", "left_semi")

    def nearest(self, asked: DataFrame, defined: DataFrame) -> DataFrame:
        """(class, name, target): those asked (class, name) that an ancestor defines, the nearest one; of one depth the first
        by the positions of the bases. All go up one base a round, until they are found."""
        here = defined.select(F.col("class").alias("ancestor"), "name", "target")
        hit = F.max(F.col("target").isNotNull()).over(Window.partitionBy("class", "name"))
        at = lambda rows: kept(rows.join(here, ["ancestor", "name"], "left").select("class", "name", "ancestor", "way", "target", hit.alias("hit")))
        frontier = at(asked.join(self.arcs, "class").groupBy("class", "name", F.col("base").alias("ancestor")).agg(F.array(F.min("position")).alias("way")))
        met, seen = [], None
        while True:
            met.append(frontier.where("target IS NOT NULL").groupBy("class", "name").agg(F.min_by("target", "way").alias("target")))
            still = frontier.where("NOT hit")
            if still.isEmpty():
                return reduce(DataFrame.union, met)
            seen = still if seen is None else seen.union(still)
            new = still.join(self.arcs.select(F.col("class").alias("ancestor"), F.col("base").alias("next"), "position"), "ancestor").where("class <> next")
            new = new.groupBy("class", "name", F.col("next").alias("ancestor")).agg(F.min(F.concat("way", F.array("position"))).alias("way"))
            frontier = at(new.join(seen.select("class", "name", "ancestor"), ["class", "name", "ancestor"], "left_anti"))

    def heirs(self, classes: DataFrame) -> DataFrame:
        """(class, heir): all classes that descend from those (class)."""
        down = self.arcs.select(F.col("base").alias("heir"), F.col("class").alias("next")).distinct()
        seen = frontier = kept(classes.join(down, classes["class"] == down["heir"]).select("class", F.col("next").alias("heir")))
        while not frontier.isEmpty():
            new = frontier.join(down, "heir").where("class <> next").select("class", F.col("next").alias("heir")).distinct()
            frontier = kept(new.join(seen, ["class", "heir"], "left_anti"))
            seen = seen.union(frontier)
        return seen

    def members(self, asked: DataFrame, defined: DataFrame, interfaces: bool) -> DataFrame:
        """(class, name, target): what asked (class, name) mean, given the members that classes define: their own, unless it
        is an interface's method; the nearest ancestor's; the only one of their descendants; their own."""
        key = ["class", "name"]
        names = defined.select("name").distinct()
        asked = kept(asked.join(names, "name", "left_semi").distinct().join(self.classes.select(F.col("symbol").alias("class"), (F.col("interface") & F.lit(interfaces)).alias("weak")), "class"))
        if asked.isEmpty():
            return defined.limit(0).select(*key, "target")
        own = kept(asked.join(defined, key).select(*key, "target", "weak"))
        done = own.where("NOT weak").select(*key, "target")
        open_ = kept(asked.select(*key).join(done, key, "left_anti"))
        if open_.isEmpty():
            return done
        done = done.union(kept(self.nearest(open_, defined)))
        left = kept(open_.join(done, key, "left_anti"))
        if left.isEmpty():
            return done
        pairs = kept(left.join(self.heirs(left.select("class").distinct()), "class"))
        theirs = pairs.select(F.col("heir").alias("class"), "name").distinct()
        held = kept(theirs.join(defined, key).select(*key, "target"))
        held = held.union(kept(self.nearest(theirs.join(held, key, "left_anti"), defined)))
        under = pairs.join(held.withColumnRenamed("class", "heir"), ["heir", "name"]).groupBy(*key).agg(F.min("target").alias("target"), F.max("target").alias("last"))
        under = kept(under.where("target = last").select(*key, "target"))
        weak = own.where("weak").select(*key, "target").join(left, key, "left_semi").join(under, key, "left_anti")
        return done.union(under).union(weak)

    def callees(self, symbols: DataFrame) -> DataFrame:
        """(symbol, callee): the function that those symbols mean: a member of a class by its name there, a class's
        constructor, or a function itself."""
        asked = symbols.select(_FRONT(F.col("symbol")).alias("class"), _LAST(F.col("symbol")).alias("name"))
        asked = asked.union(symbols.select(F.col("symbol").alias("class"), F.lit("__init__").alias("name")))
        found = self.members(asked, self.methods, True)
        by_class = found.select(F.concat_ws(".", "class", "name").alias("symbol"), F.col("target").alias("callee"), F.lit(0).alias("later"))
        made = found.where("name = '__init__'").select(F.col("class").alias("symbol"), F.col("target").alias("callee"), F.lit(0).alias("later"))
        plain = self.functions.select("symbol", F.col("symbol").alias("callee"), F.lit(1).alias("later"))
        every = by_class.union(made).union(plain).join(symbols, "symbol", "left_semi")
        return every.groupBy("symbol").agg(F.min(F.struct("later", "callee"))["callee"].alias("callee"))

    def walked(self, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Rows (module, class, scope, target: a chain) with ``symbol``, what the chain reaches, and ``type``, the class of
        the value that it gives, both null where it cannot be followed. ``known``: types of local variables."""
        names = rows.columns
        part = lambda at: F.get("_parts", at)
        bare = lambda at: F.regexp_replace(part(at), r"\(\)$", "")
        called = lambda at: F.endswith(part(at), F.lit("()"))
        rows = rows.withColumn("_parts", F.split("target", r"\.")).withColumn("head", bare(F.lit(0)))
        rounds = rows.agg(F.max(F.size("_parts")).alias("n")).first()["n"] or 0
        rows = self.rooted(rows)
        if known is None:
            rows = rows.withColumn("_local", F.lit(None).cast("string"))
        else:
            rows = rows.join(known.select("scope", F.col("name").alias("head"), F.col("type").alias("_local")), ["scope", "head"], "left")
        own = F.col("head").isin("self", "cls") & (F.col("class") != "")
        # _value: the symbol is the class of a value, not a name
        rows = rows.withColumn("symbol", F.when(own, F.col("class")).otherwise(F.coalesce("_local", "root"))).withColumn("_value", own | F.col("_local").isNotNull())
        state = self.given(kept(self.final(rows.drop("head", "root", "_local"), "symbol")), called(F.lit(0)))
        for at in range(1, rounds):
            open_ = F.col("symbol").isNotNull() & (F.size("_parts") > at)
            going = state.where(open_).withColumn("_name", bare(F.lit(at)))
            if self.attributes is None:
                going = going.withColumn("_to", F.lit(None).cast("string"))
            else:
                found = self.members(going.select(F.col("symbol").alias("class"), F.col("_name").alias("name")), self.attributes, False)
                going = going.join(found.select(F.col("class").alias("symbol"), F.col("name").alias("_name"), F.col("target").alias("_to")), ["symbol", "_name"], "left")
            going = going.withColumn("symbol", F.coalesce("_to", F.concat_ws(".", "symbol", "_name"))).withColumn("_value", F.col("_to").isNotNull())
            going = self.given(kept(self.final(going.select(*state.columns), "symbol")), called(F.lit(at)))
            state = kept(state.where(~open_).unionByName(going))
        out = state.join(self.classes.select("symbol", F.lit(True).alias("_class")), "symbol", "left").withColumn("type", F.when(F.col("_class") & F.col("_value"), F.col("symbol")))
        return out.select(*names, "symbol", "type")

    def given(self, state: DataFrame, called: Column) -> DataFrame:
        """States after a call: a class gives a value of it, a function or method one of its result type."""
        out = state.withColumn("_made", F.col("symbol").isNotNull() & called & ~F.col("_value"))
        asked = kept(out.where("_made").select("symbol").distinct())
        if asked.isEmpty():
            return state
        classes = self.classes.select("symbol").join(asked, "symbol", "left_semi")
        results = self.callees(kept(asked.join(classes, "symbol", "left_anti"))).join(self.returns, "callee").select("symbol", "result")
        out = out.join(kept(results.union(classes.select("symbol", F.col("symbol").alias("result")))), "symbol", "left")
        out = out.withColumn("symbol", F.when(F.col("_made"), F.col("result")).otherwise(F.col("symbol"))).withColumn("_value", F.col("_value") | F.col("_made"))
        return kept(out.select(*state.columns))

    def locals(self) -> DataFrame:
        """(scope, name, type): local variables whose last binding can be followed, to a fixpoint, as a binding may begin
        with another variable."""
        bound = self.facts.where("kind = 'local'").groupBy("module", "scope", "name").agg(F.max_by("target", "line").alias("target"))
        bound = kept(bound.join(self.functions.select(F.col("symbol").alias("scope"), "class"), "scope"))
        known = None
        while True:
            found = kept(self.walked(bound, known).where("type IS NOT NULL").select("scope", "name", "type"))
            if known is not None and found.exceptAll(known).isEmpty():
                return found
            heads = bound.select("scope", F.regexp_replace(F.substring_index("target", ".", 1), r"\(\)$", "").alias("name"))
            if known is None and heads.join(found, ["scope", "name"], "left_semi").isEmpty():
                return found  # no binding begins with a variable
            known = found


def repo_calls(facts: DataFrame) -> DataFrame:
    """(src, chain, callee, reached): every call of a function once, by its chain as written; what it reaches under full
    names (or the chain itself) and the function of the repository that it calls, if it is one."""
    repo = Repository(facts)
    calls = repo.facts.where("kind IN ('call', 'context')").select("module", "scope", F.col("name").alias("class"), "target").distinct()
    reached = kept(repo.walked(calls, repo.locals()))
    out = reached.join(repo.callees(kept(reached.where("symbol IS NOT NULL").select("symbol").distinct())), "symbol", "left")
    return out.select(F.col("scope").alias("src"), F.col("target").alias("chain"), "callee", F.coalesce("symbol", "target").alias("reached")).distinct()


def has_hint(text: Column, hints) -> Column:
    """Whether a text has one of some words, anywhere."""
    low = F.lower(text)
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(low, F.lit(h))
    return out


def is_write(reached: Column) -> Column:
    """Whether a call's last name is or begins with that of a writing interface."""
    last = F.lower(_LAST(reached))
    out = F.lit(False)
    for h in DB_WRITE_CALL_HINTS:
        out = out | (last == h) | F.startswith(last, F.lit(f"{h}_"))
    return out


def function_profile(calls: DataFrame) -> DataFrame:
    """(src, kind, name) of what each function does itself: writes, the adapters it goes through, transactions, retries and
    batches, from its calls (src, callee, reached)."""
    reached, front = F.col("reached"), _FRONT(F.col("reached"))
    named = lambda kind, when, what: F.when(when, F.struct(F.lit(kind).alias("kind"), what.alias("name")))
    adapter = front != ""
    short = F.when(adapter, F.concat_ws(".", _LAST(front), _LAST(reached))).otherwise(reached)
    rows = F.array_compact(
        F.array(
            named("write", is_write(reached), short),
            named("repository", adapter & has_hint(reached, REPOSITORY_ADAPTER_HINTS), _LAST(front)),
            named("driver", adapter & has_hint(reached, DRIVER_ADAPTER_HINTS), _LAST(front)),
            named("transaction", has_hint(reached, TRANSACTION_HINTS), short),
            named("retry", has_hint(reached, RETRY_HINTS), short),
            named("batch", has_hint(reached, BATCH_HINTS), short),
        )
    )
    return calls.select("src", F.inline(rows)).distinct()


def inherited_profile(calls: DataFrame, profile: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, kind, name, hops, path): what a function does itself or through the functions it calls, with the fewest calls
    between, and the first such path. A profile's name travels to the callers one call a round, each name once a function."""
    arcs = kept(calls.where("callee IS NOT NULL AND src <> callee").select(F.col("src").alias("caller"), F.col("callee").alias("src")).distinct())
    seen = frontier = kept(profile.select("src", "kind", "name", F.lit(0).alias("hops"), F.col("src").alias("path")).distinct())
    hops = 0
    while not frontier.isEmpty() and (depth is None or hops < depth):
        hops += 1
        new = frontier.join(arcs, "src").select(F.col("caller").alias("src"), "kind", "name", F.lit(hops).alias("hops"), F.concat_ws(" -> ", "caller", "path").alias("path"))
        new = new.groupBy("src", "kind", "name", "hops").agg(F.min("path").alias("path")).join(seen.select("src", "kind", "name"), ["src", "kind", "name"], "left_anti")
        frontier = kept(new)
        seen = seen.union(frontier)  # each round is written once
    return seen
