"""Batched pair grammars, rule density, and the cores and contexts that follow from it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.functions.scalars import num_to_letters, row_key
from rutine.operators.bands import in_order
from rutine.operators.scans import BLOCK, beside, running
from rutine.operators.sequence import bigram_table, bigrams, in_log, islands, running_total, within_ranges
from rutine.plans.shipping import ship
from rutine.plans.tables import drop, together, written

RULES = "log_id, level, rank, left, right, new_symbol, count"


def _rules(seq: DataFrame, level: int, before: DataFrame | None, mark: str, long: bool = False) -> DataFrame:
    """The pairs of this level, most frequent first and then earliest; names go on where earlier levels ended."""
    order = Window.partitionBy("log_id").orderBy(F.desc("count"), "first_pos")
    pairs = bigram_table(seq, "symbol", positions=False, long=long).where("count >= 2").withColumn("rank", F.row_number().over(order))
    if before is None:
        pairs = pairs.withColumn("_past", F.lit(0))
    else:
        pairs = pairs.join(before.groupBy("log_id").agg(F.count("*").alias("_past")), "log_id", "left").fillna(0, ["_past"])
    name = F.concat(F.lit(mark), num_to_letters(F.col("_past") + F.col("rank") - 1, lowercase=True))
    return pairs.select("log_id", F.lit(level).alias("level"), "rank", "left", "right", name.alias("new_symbol"), "count")


def replace_pairs(seq: DataFrame, rules: DataFrame, long: bool = False) -> DataFrame:
    """One level: rules are applied by rank, left to right, without overlap, in a closed form.

    An edge stands for a pair of neighbours; edges of a rule are candidates, ordered by (rank, position). One that comes before both
    of its neighbours is applied. From there on every second edge is, as far as its neighbours keep coming earlier on that side.
    With `long` the rows of a log are dealt in blocks, the nearest such edges being carried from block to block."""
    edges = bigrams(seq, "symbol", long).join(rules.select("log_id", "left", "right", "rank", "new_symbol"), ["log_id", "left", "right"], "left")
    own = F.when(F.col("rank").isNotNull(), F.struct("rank", "event_index"))
    edges, order, mine = edges.withColumn("_pair", own), in_log(), F.lit(True)
    if long:
        edges, order = beside(written(edges, "edges"), ["log_id"], "event_index", 1, 1)
        mine = F.col("_own")
    edges = edges.withColumn("_l", F.lag("_pair").over(order)).withColumn("_r", F.lead("_pair").over(order))
    l_first, r_first = F.coalesce(F.col("_l") < F.col("_pair"), F.lit(False)), F.coalesce(F.col("_r") < F.col("_pair"), F.lit(False))
    lowest = F.when(F.col("_pair").isNotNull() & ~l_first & ~r_first, F.col("event_index"))
    edges = edges.withColumns({"_lf": l_first, "_rf": r_first, "_low": lowest}).where(mine)
    if long:
        edges = written(edges.select("log_id", "event_index", "new_symbol", "_pair", "_lf", "_rf", "_low", (-F.col("event_index")).alias("_back")), "edges")
        edges = running(edges, ["log_id"], "event_index", {"_L": ("last", F.col("_low"))})
        edges = running(edges, ["log_id"], "_back", {"_R": ("last", F.col("_low"))})
    else:
        edges = edges.withColumn("_L", F.last("_low", ignorenulls=True).over(in_log().rowsBetween(Window.unboundedPreceding, 0)))
        edges = edges.withColumn("_R", F.first("_low", ignorenulls=True).over(in_log().rowsBetween(0, Window.unboundedFollowing)))
    even_l, even_r = (F.col("event_index") - F.col("_L")) % 2 == 0, (F.col("_R") - F.col("event_index")) % 2 == 0
    chosen = F.col("_low").isNotNull() | ((F.col("_lf") | F.col("_rf")) & (~F.col("_lf") | even_l) & (~F.col("_rf") | even_r))
    chosen = edges.where(F.col("_pair").isNotNull() & F.coalesce(chosen, F.lit(False))).select("log_id", "event_index", "new_symbol")
    if long:  # the place behind an applied pair goes, and a place moves by the pairs applied before it
        chosen = written(chosen, "chosen")
        gone = chosen.select("log_id", (F.col("event_index") + 1).alias("event_index"), F.lit(True).alias("_gone"))
        rows = seq.join(chosen, ["log_id", "event_index"], "left").join(gone, ["log_id", "event_index"], "left")
        rows = running(written(rows, "rows"), ["log_id"], "event_index", {"_moved": ("count", F.col("_gone"))}).where("_gone IS NULL")
        return rows.select(*[F.coalesce("new_symbol", "symbol").alias(c) if c == "symbol" else (F.col(c) - F.col("_moved")).alias(c) if c == "event_index" else F.col(c) for c in seq.columns])
    rows = seq.join(chosen, ["log_id", "event_index"], "left")
    rows = rows.withColumn("_gone", F.lag("new_symbol").over(in_log()).isNotNull()).where("NOT _gone")
    rows = rows.withColumn("symbol", F.coalesce("new_symbol", "symbol")).drop("new_symbol", "_gone")
    return rows.withColumn("event_index", F.row_number().over(in_log()) - F.lit(1).cast("long"))


def re_pair(log: DataFrame, column: str = "symbol", long: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rules, encoded sequences) of all logs at once, level by level until no pair occurs twice. `long` deals the rows of each log in blocks.

    Rules are named a, b, ...; where symbols of the column may be called so, all names get a mark in front that no symbol has.

    A rule's count is that at the start of its level, and a rule is there even if nothing was left for it to replace. Both
    are written tables; a level costs a job over what is left of all logs, and there are about as many levels as the logarithm
    of the longest repetition."""
    seq = written(log.select("log_id", F.col("event_index").cast("long").alias("event_index"), F.col(column).alias("symbol")), "sequence")
    made, level = [], 1
    small = seq.where(F.col("symbol").rlike("^~*[a-z]+$")).agg(F.max(F.length(F.regexp_extract("symbol", "^~*", 0)))).first()[0]
    mark = "" if small is None else "~" * (small + 1)
    while True:
        new = written(_rules(seq, level, together(made) if made else None, mark, long), "rules")
        if new.isEmpty():
            return together(made or [new]), seq
        old, seq = seq, written(replace_pairs(seq, new, long), "sequence")
        drop(old)
        made.append(new)
        level += 1


def expansions(rules: DataFrame, base: bool = False) -> DataFrame:
    """(log_id, symbol, expansion) of every rule as an array of base symbols; with base, of the base symbols in rules too."""
    names = rules.select("log_id", F.col("new_symbol").alias("symbol"))
    known = rules.select("log_id", F.explode(F.array("left", "right")).alias("symbol")).distinct().join(names, ["log_id", "symbol"], "left_anti")
    made = [written(known.select("log_id", "symbol", F.array("symbol").alias("expansion"), F.lit(0).alias("level")), "expansions")]
    for level in range(1, (rules.agg(F.max("level")).first()[0] or 0) + 1):
        known = together(made)
        one = known.select("log_id", F.col("symbol").alias("left"), F.col("expansion").alias("_l"))
        two = known.select("log_id", F.col("symbol").alias("right"), F.col("expansion").alias("_r"))
        new = rules.where(F.col("level") == level).join(one, ["log_id", "left"]).join(two, ["log_id", "right"])
        made.append(written(new.select("log_id", F.col("new_symbol").alias("symbol"), F.concat("_l", "_r").alias("expansion"), "level"), "expansions"))
    return together(made).where(F.lit(True) if base else F.col("level") > 0).select("log_id", "symbol", "expansion")


def expand(seq: DataFrame, rules: DataFrame) -> DataFrame:
    """Encoded sequences as base symbols again."""
    e = expansions(rules)
    rows = seq.join(e, ["log_id", "symbol"], "left").withColumn("expansion", F.coalesce("expansion", F.array("symbol")))
    rows = rows.select("log_id", "event_index", F.posexplode("expansion").alias("_at", "symbol"))
    return rows.select("log_id", (F.row_number().over(Window.partitionBy("log_id").orderBy("event_index", "_at")) - F.lit(1).cast("long")).alias("event_index"), "symbol")


def rules_with(rules: DataFrame, symbol: str, recursive: bool = False) -> DataFrame:
    """Rules that hold a symbol, or, recursively, hold a rule that does."""
    hits = lambda of: rules.join(of, (rules["log_id"] == of["_log"]) & ((rules["left"] == of["_s"]) | (rules["right"] == of["_s"])), "left_semi")
    found = rules.where((F.col("left") == symbol) | (F.col("right") == symbol))
    while recursive:
        found = written(found, "closure")
        of = found.select(F.col("log_id").alias("_log"), F.col("new_symbol").alias("_s"))
        more = found.unionByName(hits(of)).distinct()
        if more.count() == found.count():
            break
        found = more
    return found


def rule_density(log: DataFrame, patterns: DataFrame, column: str = "symbol", long: bool = False) -> DataFrame:
    """log with rule_density_count: how many occurrences of patterns (log_id, expansion) cover each event. Overlaps and
    patterns that are there twice count. Starts and ends are summed along the log.

    Lengths from one power of two to the next are one equi-join of arrays, over the logs that have such patterns and the lengths that each has.
    Each such join is a job that writes its steps, so no plan grows with the number of lengths, however many logs bring them. `long` deals the
    rows of each log in blocks, whose counts are carried on."""
    log = log.withColumn("event_index", F.col("event_index").cast("long"))
    whole = patterns.where(~F.exists("expansion", lambda x: x.isNull())).groupBy("log_id", "expansion").agg(F.count("*").alias("k"))
    counted = written(whole.withColumn("_n", F.size("expansion")).withColumn("_bits", F.length(F.bin("_n"))), "patterns")
    longest = sorted(counted.where("_n > 0").groupBy("_bits").agg(F.max("_n")).collect())  # a row for each power of two, never patterns
    if not longest:
        return log.withColumn("rule_density_count", F.lit(0).cast("long"))
    rows, steps = written(log.select("log_id", "event_index", F.array(column).alias("_symbol")), "events"), []
    for bits, most in longest:
        some = counted.where(F.col("_bits") == bits)
        here, order = beside(rows, ["log_id"], "event_index", 0, most - 1, max(BLOCK, most)) if long else (rows.withColumn("_own", F.lit(True)), in_log())
        ahead = F.flatten(F.collect_list("_symbol").over(order.rowsBetween(0, most - 1)))
        here = here.select("log_id", "event_index", ahead.alias("_ahead"), "_own").where("_own") if long else here.withColumn("_ahead", ahead)
        here = here.join(some.groupBy("log_id").agg(F.collect_set("_n").alias("_lengths")), "log_id").select("log_id", "event_index", "_ahead", "_lengths")
        here = here.select("log_id", "event_index", "_ahead", F.explode("_lengths").alias("_n")).where(F.size("_ahead") >= F.col("_n"))
        hits = here.select("log_id", "event_index", F.slice("_ahead", 1, F.col("_n")).alias("expansion")).join(some, ["log_id", "expansion"])
        ends = F.array(F.struct(F.col("event_index").alias("event_index"), F.col("k").alias("k")), F.struct((F.col("event_index") + F.col("_n")).alias("event_index"), (-F.col("k")).alias("k")))
        part = hits.select("log_id", F.explode(ends).alias("s")).groupBy("log_id", "s.event_index").agg(F.sum("s.k").alias("_step"))
        steps.append(written(part, "steps"))
    drop(rows, counted)
    step = together(steps).groupBy("log_id", "event_index").agg(F.sum("_step").alias("_step"))
    out = log.join(step.hint("merge"), ["log_id", "event_index"], "left")
    if long:
        out = running(written(out, "steps"), ["log_id"], "event_index", {"rule_density_count": ("sum", F.coalesce("_step", F.lit(0)))})
        return out.withColumn("rule_density_count", F.col("rule_density_count").cast("long")).drop("_step")
    return out.withColumn("rule_density_count", running_total(F.coalesce("_step", F.lit(0))).cast("long")).drop("_step")


def density_of(log: DataFrame, rules: DataFrame, column: str = "symbol", long: bool = False) -> DataFrame:
    """Rule density of a log by its own grammar; base symbols that take part in rules count like rules of length 1."""
    return rule_density(log, expansions(rules, base=True), column, long)


def cutoffs(log: DataFrame, method: str = "percentile", value: float = 0.9, column: str = "rule_density_count") -> DataFrame:
    """(log_id, cutoff): 'percentile' the quantile; 'relative' a share of the largest; 'absolute' the value; 'mad' the median of non-zero counts and
    three times the median deviation from it."""
    if method == "mad":
        some = log.where(F.col(column) != 0)
        mid = some.groupBy("log_id").agg(F.expr(f"percentile({column}, 0.5)").alias("m"))
        dev = some.join(mid, "log_id").groupBy("log_id", "m").agg(F.expr(f"percentile(abs({column} - m), 0.5)").alias("d"))
        return dev.select("log_id", (F.col("m") + 3 * F.col("d")).alias("cutoff"))
    how = {"percentile": F.expr(f"percentile({column}, {value})"), "relative": F.max(column) * value, "absolute": F.max(F.lit(float(value)))}
    return log.groupBy("log_id").agg(how[method].cast("double").alias("cutoff"))


def cores(log: DataFrame, method: str = "percentile", value: float = 0.9, merge_gap: int | None = None, column: str = "rule_density_count", long: bool = False) -> DataFrame:
    """Runs of events at or above the cutoff: (log_id, core_id, start_index, end_index, length). No such event: no core."""
    dense = log.join(cutoffs(log, method, value, column), "log_id").where(F.col(column) >= F.col("cutoff"))
    found = islands(dense.select("log_id", "event_index"), merge_gap, long)
    return found.withColumn("core_id", F.row_number().over(Window.partitionBy("log_id").orderBy("start_index")) - 1)


def app_switches(log: DataFrame, core: DataFrame, columns: list[str], long: bool = False) -> DataFrame:
    """Cores with lower_app_switch and upper_app_switch, from the runs of equal application rows at their ends.

    A bound is the core's own if it is the first (last) row of its run, else one inside of the run's first (last) row."""
    rows = log.select("log_id", "event_index", row_key(*columns).alias("_key"))
    rows, order = beside(rows, ["log_id"], "event_index", 1, 1) if long else (rows.withColumn("_own", F.lit(True)), in_log())
    new = F.coalesce(F.col("_key") != F.lag("_key").over(order), F.lit(True))
    end = F.coalesce(F.col("_key") != F.lead("_key").over(order), F.lit(True))
    rows = rows.withColumns({"_new": F.when(new, F.col("event_index")), "_end": F.when(end, F.col("event_index"))}).where("_own").select("log_id", "event_index", "_new", "_end")
    if long:
        rows = written(rows, "ends")
        low = running(rows, ["log_id"], "event_index", {"_first": ("last", F.col("_new"))}).select("log_id", F.col("event_index").alias("start_index"), "_first")
        back = rows.withColumn("_back", -F.col("event_index"))
        high = running(back, ["log_id"], "_back", {"_last": ("last", F.col("_end"))}).select("log_id", F.col("event_index").alias("end_index"), "_last")
    else:
        low = rows.select("log_id", F.col("event_index").alias("start_index"), F.last("_new", ignorenulls=True).over(in_log().rowsBetween(Window.unboundedPreceding, 0)).alias("_first"))
        high = rows.select("log_id", F.col("event_index").alias("end_index"), F.first("_end", ignorenulls=True).over(in_log().rowsBetween(0, Window.unboundedFollowing)).alias("_last"))
    out = core.join(low, ["log_id", "start_index"]).join(high, ["log_id", "end_index"])
    lower = F.when(F.col("_first") == F.col("start_index"), F.col("start_index")).otherwise(F.col("_first") + 1)
    upper = F.when(F.col("_last") == F.col("end_index"), F.col("end_index")).otherwise(F.col("_last") - 1)
    return out.withColumn("lower_app_switch", lower).withColumn("upper_app_switch", upper).drop("_first", "_last")


def _walk(keys: list, places: list[int], step: int, least: float) -> list[int]:
    """How many steps each place survives: at each depth, keys shared by at least `least` of those still there go on."""
    depth, alive, survived = 0, list(range(len(places))), [0] * len(places)
    while alive and len(alive) >= least:
        depth += 1
        groups: dict = {}
        for i in alive:
            at = places[i] + step * depth
            if 0 <= at < len(keys):
                groups.setdefault(keys[at], []).append(i)
        alive = [i for g in groups.values() if len(g) >= least for i in g]
        for i in alive:
            survived[i] = depth
    return survived


#: A prime below 2^31, and a base for each of the two hashes of a path.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_069_069)


def _power(base: int, n: Column, bits: int) -> Column:
    """base to the power of n, less than 2^bits, modulo PRIME."""
    out = F.lit(1).cast("long")
    for b in range(bits):
        out = F.pmod(out * F.when(F.shiftright(n, b).bitwiseAND(1) == 1, F.lit(pow(base, 1 << b, PRIME))).otherwise(F.lit(1)), F.lit(PRIME))
    return out


def _block(start: str, end: str, at: Column, bits: int) -> Column:
    """The name of the keys after place `at`, up to where the sums `end` are taken; it does not tell where they lie."""
    parts = [F.pmod(F.pmod(F.col(f"{end}.s{i}") - F.col(f"{start}.s{i}"), F.lit(PRIME)) * _power(pow(b, -1, PRIME), at, bits), F.lit(PRIME)) for i, b in enumerate(BASES)]
    return F.shiftleft(parts[0], 31) + parts[1]


def _steps(keys: DataFrame, places: DataFrame, share: float) -> DataFrame:
    """(log_id, core_id, steps): how many keys after its place (log_id, core_id, at) each core shares with at least `share`, over one half, of the log's cores.

    Of more than half there is but one group, and that of a longer path is part of that of a shorter one. So the depth of each log is found bit by bit, the
    highest first; each core then goes as far as its path equals that of a core which went all the way, again bit by bit. Two
    stretches of keys are compared by sums up to their ends, of two polynomials modulo PRIME."""
    longest = keys.agg(F.max("event_index")).first()[0] or 0
    bits = max(1, (int(longest) + 1).bit_length())
    terms = {f"t{i}": F.pmod(F.pmod(F.xxhash64("key", F.lit(i)), F.lit(PRIME)) * _power(b, F.col("event_index"), bits), F.lit(PRIME)) for i, b in enumerate(BASES)}
    terms = written(keys.select("log_id", "event_index", *[c.alias(n) for n, c in terms.items()]), "terms")
    sums = running(terms, ["log_id"], "event_index", {f"s{i}": ("sum", F.col(f"t{i}")) for i in range(len(BASES))})
    sums = written(sums.select("log_id", F.col("event_index").alias("_to"), F.struct(*[f"s{i}" for i in range(len(BASES))]).alias("_sum")), "sums")
    drop(terms)

    def look(rows: DataFrame, at: Column, name: str) -> DataFrame:
        return rows.withColumn("_to", at.cast("long")).join(sums, ["log_id", "_to"], "left").drop("_to").withColumnRenamed("_sum", name)

    start = written(look(places, F.col("at"), "_s"), "starts")
    least = written(places.groupBy("log_id").agg((F.lit(share) * F.count("*")).alias("_least")), "least")
    state = start.withColumn("d", F.lit(0).cast("long"))
    for k in reversed(range(bits)):  # the path of the largest group, and who is on it
        tried = look(state, F.col("at") + F.col("d") + (1 << k), "_e").withColumn("_name", _block("_s", "_e", F.col("at") + F.col("d"), bits))
        best = tried.where("_name IS NOT NULL").groupBy("log_id", "_name").agg(F.count("*").alias("_n")).join(least, "log_id")
        best = best.where("_n >= _least").select("log_id", F.col("_name").alias("_best"))
        tried = tried.join(best, "log_id", "left").where("_best IS NULL OR _name = _best")
        on = F.col("_best").isNotNull()
        tried = tried.select("log_id", "core_id", "at", F.when(on, F.col("_e")).otherwise(F.col("_s")).alias("_s"), (F.col("d") + F.when(on, 1 << k).otherwise(0)).alias("d"))
        old, state = state, written(tried, "paths")
        if hasattr(old, "_rutine_path"):
            drop(old)
    lead = state.groupBy("log_id").agg(F.min("at").alias("_lead"), F.max("d").alias("_depth"))
    rows = start.join(lead, "log_id").select("log_id", "core_id", "at", "_s", "_lead", "_depth", F.lit(0).cast("long").alias("steps"))
    rows = written(look(rows, F.col("_lead"), "_t"), "walks")
    for k in reversed(range(bits)):  # how far each is on that path
        here = F.col("steps") + (1 << k)
        tried = look(look(rows, F.when(here <= F.col("_depth"), F.col("at") + here), "_e"), F.when(here <= F.col("_depth"), F.col("_lead") + here), "_f")
        same = F.coalesce(_block("_s", "_e", F.col("at") + F.col("steps"), bits) == _block("_t", "_f", F.col("_lead") + F.col("steps"), bits), F.lit(False))
        tried = tried.withColumn("_same", same)
        tried = tried.select("log_id", "core_id", "at", F.when(F.col("_same"), F.col("_e")).otherwise(F.col("_s")).alias("_s"), "_lead", "_depth",
                             F.when(F.col("_same"), here).otherwise(F.col("steps")).alias("steps"), F.when(F.col("_same"), F.col("_f")).otherwise(F.col("_t")).alias("_t"))
        old, rows = rows, written(tried, "walks")
        drop(old)
    drop(start, sums, least, state)
    return rows.select("log_id", "core_id", "steps")


def path_walk(log: DataFrame, core: DataFrame, columns: list[str], share: float = 0.8, long: bool = False) -> DataFrame:
    """Cores with lower_pattern_switch and upper_pattern_switch: how far the applications before (after) them are those of
    at least `share` of the log's cores too. Starts are the cores' lower and upper application switches, if they are there.

    With `long` and a share over one half the rows of a log are dealt, and paths are compared by hashes of 62 bits; places are
    0, 1, ... without gaps. A smaller share allows several groups, which may meet again: that walk goes step by step, a log being one task."""
    lo = "lower_app_switch" if "lower_app_switch" in core.columns else "start_index"
    hi = "upper_app_switch" if "upper_app_switch" in core.columns else "end_index"
    keys = log.select("log_id", "event_index", row_key(*columns).alias("key"))
    kind = log.schema["log_id"].dataType.simpleString()
    if long and share > 0.5:
        keys, core = written(keys, "keys"), written(core, "cores")
        ends = keys.groupBy("log_id").agg(F.max("event_index").alias("_end"))
        back = keys.join(ends, "log_id").select("log_id", (F.col("_end") - F.col("event_index")).alias("event_index"), "key")
        at = core.join(ends, "log_id").select("log_id", "core_id", (F.col("_end") - F.col(lo)).cast("long").alias("at"))
        down = _steps(back, at, share).withColumnRenamed("steps", "_down")
        up = _steps(keys, core.select("log_id", "core_id", F.col(hi).cast("long").alias("at")), share).withColumnRenamed("steps", "_up")
        out = core.join(down, ["log_id", "core_id"]).join(up, ["log_id", "core_id"])
        return out.withColumn("lower_pattern_switch", F.col(lo) - F.col("_down")).withColumn("upper_pattern_switch", F.col(hi) + F.col("_up")).drop("_down", "_up")
    ship(log.sparkSession)
    at = F.struct("core_id", F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"))
    places = core.groupBy("log_id").agg(F.array_sort(F.collect_list(at)).alias("places"))
    walks = in_order(keys, "key", "keys").join(places.hint("merge"), "log_id").select("log_id", "keys", "places.core_id", "places.lo", "places.hi")

    def run(batches):
        for b in batches:
            ids, told = [], ([], [], [])
            for r in range(b.num_rows):
                key, core_id, low, high = (b.column(x)[r].as_py() for x in range(1, 5))
                down, up = _walk(key, low, -1, share * len(core_id)), _walk(key, high, 1, share * len(core_id))
                ids += [r] * len(core_id)
                for out, values in zip(told, (core_id, [x - d for x, d in zip(low, down, strict=True)], [x + d for x, d in zip(high, up, strict=True)]), strict=True):
                    out += values
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), *(pa.array(x, t) for x, t in zip(told, (pa.int32(), pa.int64(), pa.int64()), strict=True))], names=["log_id", "core_id", "lower_pattern_switch", "upper_pattern_switch"]
            )

    found = walks.mapInArrow(run, f"log_id {kind}, core_id int, lower_pattern_switch long, upper_pattern_switch long")
    return core.join(found, ["log_id", "core_id"])


def reduce_log(log: DataFrame, core: DataFrame, margin_factor: float = 2.0, lower: str = "lower_pattern_switch", upper: str = "upper_pattern_switch", long: bool = False) -> DataFrame:
    """Events around cores: bounds are widened by margin_factor times their distance; the last event of a log is never kept."""
    ends = log.groupBy("log_id").agg(F.max("event_index").alias("_last"))
    margin = (F.col(upper) - F.col(lower)) * margin_factor
    ranges = core.join(ends, "log_id").select("log_id", F.ceil(F.greatest(F.lit(0.0), F.col(lower) - margin)).cast("long").alias("lo"), F.ceil(F.least(F.col(upper) + margin, F.col("_last").cast("double"))).cast("long").alias("hi"))
    return within_ranges(log, ranges, long)


def motif_length_bounds(core: DataFrame, margin_factor: float = 2.0, lower: str = "lower_pattern_switch", upper: str = "upper_pattern_switch") -> DataFrame:
    """(log_id, l_min, l_max) of a motif search: at least 5, or the mean core length less its deviation; at most the largest margin."""
    low = F.coalesce(F.greatest(F.lit(5.0), F.avg("length") - F.stddev_samp("length")), F.lit(5.0))
    return core.groupBy("log_id").agg(low.alias("l_min"), F.max((F.col(upper) - F.col(lower)) * margin_factor).alias("l_max"))
