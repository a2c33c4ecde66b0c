"""Row validation kernel (V1-V15, gates C1-C11 inside the chain, V14).

Every rule is a boolean Column that is true when the row is rejected.  The
chain is ONE projection: ``coalesce(when(r1, 0), when(r2, 1), ...)`` gives
the index of the first failing rule, so a rejected row is reported once, by
the first rule that fails, in header order - the same outcome as removing
rows rule by rule, in a single pass that stays in whole-stage codegen.

Each rule also carries its DuckDB twin (``sql``) so oracle queries are built
from the same rule list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.types import INTEGER_LIMITS, NUMERIC_LIMITS
from .catalog import ColumnSpec, TableSpec

# Rule texts used in quarantine rows and error details.
RULE_TEXT = {
    "C1": "tab name is not update_* or insert_*",
    "C2": "table name is not schema.table",
    "C3": "table does not exist",
    "C4": "tab has no data rows",
    "C5": "table has no catalog columns",
    "C6": "column does not exist in the table",
    "C8": "insert carries a primary-key column",
    "C9": "update carries more than one primary-key column",
    "C10": "table has no primary key to update by",
    "C11": "update carries no primary-key column",
    "V1": "longer than the declared length",
    "V2": "not a number",
    "V3": "contains no digit",
    "V3b": "has a fractional part",
    "V4": "below the type minimum",
    "V5": "above the type maximum",
    "V6": "longer than the declared length",
    "V7": "not a date/time",
    "V8": "not a number",
    "V9": "below the type minimum",
    "V10": "above the type maximum",
    "V11": "more integer digits than the precision",
    "V15": "more fraction digits than the scale",
    "V15b": "does not fit the declared precision and scale",
    "V12": "NULL where the column is not nullable",
    "V13": "NULL primary key",
    "C17": "insert leaves out a column that is not nullable",
    "D2": "key does not exist in the table",
}

TAB_GATES_HEAD = ("C1", "C2", "C3", "C4", "C5")
TAB_GATES_KEY = ("C8", "C9", "C10", "C11")


Prep = tuple[str, Callable[[], Column]]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    column: str | None
    data_type: str | None
    make: Callable[[], Column]     # built lazily: oracle SQL needs no Spark context
    sql: str
    prep: tuple[Prep, ...] = ()    # columns parsed once per row before the chain

    @property
    def cond(self) -> Column:
        return self.make()

    @property
    def message(self) -> str:
        text = RULE_TEXT[self.rule_id]
        return f"{text} ({self.data_type})" if self.data_type else text


def qcol(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def qsql(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _always() -> Column:
    return F.lit(True)


PREP_PREFIX = "__p_"


def prep_name(kind: str, name: str) -> str:
    return f"{PREP_PREFIX}{kind}_{name}"


def column_preps(name: str, floating: bool = False) -> dict[str, Prep]:
    """Per-column values parsed once per row: number test, exact and double value, timestamp.

    Spark does not share a subexpression between the branches of the chain's
    ``coalesce(when ...)``, so without this each rule would parse the cell again."""
    def lng() -> Column:
        return F.trim(qcol(name)).try_cast("bigint")

    # what casts and is plain text is a number by the grammar too; only the rest meets its regular expression
    def num() -> Column:
        return F.when(S.is_plain(qcol(name)) & lng().isNotNull(), F.lit(True)).otherwise(S.is_number(qcol(name), floating))

    def dnum() -> Column:
        return F.when(S.is_plain(qcol(name)) & S.as_decimal(qcol(name)).isNotNull(), F.lit(True)).otherwise(S.is_number(qcol(name), floating))

    return {
        "num": (prep_name("num", name), num),
        "dnum": (prep_name("num", name), dnum),
        # plain integers parse as a long; only the rest pay for the 38-digit decimal
        "lng": (prep_name("lng", name), lng),
        "idec": (prep_name("dec", name), lambda: F.when(lng().isNull(), S.as_decimal(qcol(name)))),
        "idbl": (prep_name("dbl", name), lambda: F.when(lng().isNull() & S.as_decimal(qcol(name)).isNull(),
                                                         S.as_double(qcol(name)))),
        "dec": (prep_name("dec", name), lambda: S.as_decimal(qcol(name))),
        "dbl": (prep_name("dbl", name), lambda: F.when(S.as_decimal(qcol(name)).isNull(), S.as_double(qcol(name)))),
        "ts": (prep_name("ts", name), lambda: S.parse_datetime(qcol(name))),
    }


def column_rules(spec: ColumnSpec, name: str, *, skip_null_check: bool = False) -> list[Rule]:
    """Rules for one batch column ``name`` declared as ``spec``, in check order."""
    q, t = qsql(name), spec.data_type.lower()
    fam = spec.family
    out: list[Rule] = []
    floating = t in ("float", "real")
    preps = column_preps(name, floating)

    def c() -> Column:
        return qcol(name)

    def p(kind: str) -> Column:
        return F.col(preps[kind][0])

    def add(rule_id: str, make: Callable[[], Column], sql: str, *kinds: str) -> None:
        out.append(Rule(rule_id, name, t, make, sql, tuple(preps[k] for k in kinds)))

    def lt(a, b):
        return a < b

    def gt(a, b):
        return a > b

    n = spec.char_max_len
    has_len = n is not None and n > 0
    if fam == "text":
        if has_len:
            add("V1", lambda: S.text_length(c()) > n, f"{S.text_length_sql(q)} > {n}")
    elif fam == "integer":
        lo, hi = INTEGER_LIMITS[t]
        add("V2", lambda: ~p("num"), f"NOT {S.is_number_sql(q)}", "num")
        add("V3", lambda: ~(p("num") | S.has_digit(c())), f"NOT {S.has_digit_sql(q)}", "num")
        add("V3b", lambda: p("idec") != F.floor(p("idec")), S.is_fractional_sql(q), "idec")
        add("V4", lambda: F.coalesce(p("lng") < F.lit(lo), S.compare_parsed(p("idec"), p("idbl"), lo, lt)),
            S.below_sql(q, lo), "lng", "idec", "idbl")
        add("V5", lambda: F.coalesce(p("lng") > F.lit(hi), S.compare_parsed(p("idec"), p("idbl"), hi, gt)),
            S.above_sql(q, hi), "lng", "idec", "idbl")
        if has_len:
            add("V6", lambda: S.text_length(c()) > n, f"{S.text_length_sql(q)} > {n}")
    elif fam == "datetime":
        if t == "time":
            add("V7", lambda: c().isNotNull() & ~S.is_time(c()), f"({q} IS NOT NULL AND NOT {S.is_time_sql(q)})")
        else:
            add("V7", lambda: c().isNotNull() & p("ts").isNull(),
                f"({q} IS NOT NULL AND {S.parse_datetime_sql(q)} IS NULL)", "ts")
    elif fam == "numeric":
        add("V8", lambda: ~p("dnum"), f"NOT {S.is_number_sql(q, floating)}", "dnum")
        if t in NUMERIC_LIMITS:
            nlo, nhi = NUMERIC_LIMITS[t]
            add("V9", lambda: S.compare_parsed(p("dec"), p("dbl"), nlo, lt), S.below_sql(q, nlo), "dec", "dbl")
            add("V10", lambda: S.compare_parsed(p("dec"), p("dbl"), nhi, gt), S.above_sql(q, nhi), "dec", "dbl")
        prec = spec.precision
        if prec is not None:
            # the digits are counted only in texts long enough to have too many
            add("V11", lambda: (F.length(c()) > prec) & (S.integer_digits(c()) > prec), f"{S.integer_digits_sql(q)} > {prec}")
        if t in ("decimal", "numeric"):
            sc = spec.scale
            if sc is not None:
                add("V15", lambda: (F.instr(c(), ".") > 0) & (F.length(c()) - F.instr(c(), ".") > sc) & (S.fraction_digits(c()) > sc),
                    f"{S.fraction_digits_sql(q)} > {sc}")
            if prec is not None:
                s0 = sc or 0
                add("V15b", lambda: c().isNotNull() & ~S.fits_decimal(c(), prec, s0),
                    f"({q} IS NOT NULL AND NOT {S.fits_decimal_sql(q, prec, s0)})")
    if not spec.nullable and not skip_null_check:
        add("V12", lambda: c().isNull(), f"({q} IS NULL)")
    return out


@dataclass(frozen=True)
class Envelope:
    """What the gates know about a tab: its name, target, header."""

    tab: str
    table: str | None
    header: tuple[str, ...]


def tab_mode(tab: str) -> str | None:
    low = (tab or "").lower()
    if "update_" in low:
        return "update"
    if "insert_" in low:
        return "insert"
    return None


def key_columns(spec: TableSpec, header: tuple[str, ...]) -> list[str]:
    """Header columns that are primary-key columns, in key order."""
    low = [h.lower() for h in header]
    return [h for k in spec.primary_key for h in header if h.lower() == k.lower()] if low else []


def envelope_gate(env: Envelope, spec: TableSpec | None, table_exists: bool, n_rows: int | None = None
                  ) -> tuple[str | None, str | None]:
    """Gate outcome of a tab from metadata: (gate id or None, update key column)."""
    mode = tab_mode(env.tab)
    if mode is None:
        return "C1", None
    if not env.table or len(env.table.split(".")) != 2:
        return "C2", None
    if not table_exists:
        return "C3", None
    if n_rows is not None and n_rows == 0:
        return "C4", None
    if spec is None or not spec.columns:
        return "C5", None
    keys = key_columns(spec, env.header)
    if mode == "insert":
        return ("C8", None) if keys else (None, None)
    if len(keys) > 1:
        return "C9", None
    if not spec.primary_key:
        return "C10", None
    if not keys:
        return "C11", None
    return None, keys[0]


def missing_required(spec: TableSpec, header: tuple[str, ...]) -> list[str]:
    """C17: NOT NULL columns an insert leaves out (the primary key is generated and a default fills in, so both are exempt)."""
    have = {h.lower() for h in header}
    keys = {k.lower() for k in spec.primary_key}
    return [c.name for c in spec.columns if not c.nullable and c.default is None and c.name.lower() not in have
            and c.name.lower() not in keys]


def build_rules(spec: TableSpec | None, env: Envelope, gate: str | None, key: str | None,
                require_not_null: bool = False) -> list[Rule]:
    """The full chain of one tab: head gates, columns in header order, key gates, V13.

    ``require_not_null`` turns on C17 (off by default, as in the source tool)."""
    if gate in TAB_GATES_HEAD:
        return [Rule(gate, None, None, _always, "TRUE")]
    rules: list[Rule] = []
    mode = tab_mode(env.tab)
    for name in env.header:
        cs = spec.column(name) if spec else None
        if cs is None:
            rules.append(Rule("C6", name, None, _always, "TRUE"))
            break  # every remaining row is rejected here
        rules.extend(column_rules(cs, name, skip_null_check=(mode == "update" and key is not None
                                                             and name.lower() == key.lower())))
    if gate in TAB_GATES_KEY:
        rules.append(Rule(gate, None, None, _always, "TRUE"))
    elif require_not_null and mode == "insert" and spec is not None and missing_required(spec, env.header):
        rules.append(Rule("C17", missing_required(spec, env.header)[0], None, _always, "TRUE"))
    elif mode == "update" and key is not None:
        rules.append(Rule("V13", key, None, lambda: qcol(key).isNull(), f"({qsql(key)} IS NULL)"))
    return rules


RULE_INDEX = "_rule"


def apply_chain(df: DataFrame, rules: list[Rule], keep_prep: bool = False) -> DataFrame:
    """Add ``rule_id``, ``rule_column``, ``rule_message``; NULL rule_id = accepted.

    One projection adds the per-column parsed values, the next one the chain;
    ``keep_prep`` keeps the parsed values for the typed projection."""
    preps = {}
    for r in rules:
        for name, make in r.prep:
            preps.setdefault(name, make)
    if preps:
        df = df.select("*", *[make().alias(name) for name, make in preps.items()])
    out = _chain(df, rules)
    return out if keep_prep else out.drop(*preps)


def _segments(rules: list[Rule]) -> list[list[tuple[int, Rule]]]:
    """Consecutive rules of the same column (gates alone), with their 1-based chain index."""
    segs: list[list[tuple[int, Rule]]] = []
    for i, r in enumerate(rules, start=1):
        if segs and r.column is not None and segs[-1][-1][1].column == r.column:
            segs[-1].append((i, r))
        else:
            segs.append([(i, r)])
    return segs


def _chain(df: DataFrame, rules: list[Rule]) -> DataFrame:
    if not rules:
        return (df.withColumn("rule_id", F.lit(None).cast("string"))
                .withColumn("rule_column", F.lit(None).cast("string"))
                .withColumn("rule_message", F.lit(None).cast("string")))
    # One small expression per column (each compiles to its own JIT-friendly method),
    # then the first column, in header order, that failed.
    segs = _segments(rules)
    seg_cols = [f"{RULE_INDEX}{k}" for k in range(len(segs))]
    df = df.select("*", *[F.coalesce(*[F.when(r.cond, F.lit(i)) for i, r in seg]).alias(name)
                          for seg, name in zip(segs, seg_cols)])
    idx = F.coalesce(*[F.col(c) for c in seg_cols])
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    cols = F.array(*[F.lit(r.column).cast("string") for r in rules])
    msgs = F.array(*[F.lit(r.message) for r in rules])
    i = F.col(RULE_INDEX)

    def pick(values: Column) -> Column:
        # guarded: element_at over a literal array does not return NULL for a NULL index
        return F.when(i.isNotNull(), F.element_at(values, i))

    # Barrier: spark_partition_id() is non-deterministic to the optimizer, so a later filter on
    # the rule (e.g. "accepted rows only") stays above this projection instead of being pushed
    # below it with every parsed value inlined (and re-evaluated) into one filter on the scan.
    barrier = F.spark_partition_id() >= 0
    return (df.withColumn(RULE_INDEX, F.when(barrier, idx))
            .withColumn("rule_id", pick(ids))
            .withColumn("rule_column", pick(cols))
            .withColumn("rule_message", pick(msgs))
            .drop(RULE_INDEX, *seg_cols))


def chain_sql(rules: list[Rule]) -> dict[str, str]:
    """DuckDB twin of :func:`apply_chain`: the three output expressions."""
    if not rules:
        return {k: "CAST(NULL AS VARCHAR)" for k in ("rule_id", "rule_column", "rule_message")}

    def case(values: list[str | None]) -> str:
        arms = " ".join(f"WHEN {r.sql} THEN {S.sql_str(v) if v is not None else 'CAST(NULL AS VARCHAR)'}"
                        for r, v in zip(rules, values))
        return f"CASE {arms} END"

    return {"rule_id": case([r.rule_id for r in rules]),
            "rule_column": case([r.column for r in rules]),
            "rule_message": case([r.message for r in rules])}


def validate(batch: DataFrame, spec: TableSpec | None, env: Envelope, *, table_exists: bool = True,
             gate: str | None = None, key: str | None = None, keep_prep: bool = False) -> DataFrame:
    """Annotate every batch row with its first failing rule."""
    if gate is None and key is None:
        gate, key = envelope_gate(env, spec, table_exists)
    return apply_chain(batch, build_rules(spec, env, gate, key), keep_prep=keep_prep)
