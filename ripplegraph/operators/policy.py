"""Policies: rules compiled to three-valued column expressions and evaluated over all subjects at once.

A policy is plain data:

    {"version": 1,
     "defaults": {"on_missing_meta": "fail_closed", "on_error": "fail_closed", "warn_rules_fire_on_unknown": False},
     "rules": [{"name": ..., "when": <predicate>, "decision": "block" | "warn"}]}

A predicate is one of {"all": [...]}, {"any": [...]}, {"not": p} or a leaf:

    {"field": name, "op": operator, "value": x}                 a plain column of the subjects
    {"change": {"field": f, "op": ..., "value": ...}}           f is kind, semantic, breaking, model or column
    {"meta": {"key": "a.b", "op": ..., "value": ...}}           the column's metadata, else its model's
    {"inferred_meta": {...}}, {"config": {...}}                 inherited metadata; the model's configuration
    {"structural": {"fact": f}}                                 provable_test_break, touches_exposure or reaches_anything
    {"reach": {"kind": k, "mechanism": [...], "where": p, "min_count": n}}    n reached objects of a kind satisfy p

The typed leaves read these columns of the subjects: model, column, kind, semantic; column_meta, model_meta, config
(VARIANT); inferred (map of key to 0, 1 or 2); resolved, provable_break (boolean); n_exposures, n_reached (long).  Reached objects have
reached_kind (model, column or exposure), name, mechanism, meta, config, inferred, and for exposures type, owner and
dashboard (VARIANT, NULL if it is none of a BI tool's).
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import meta, tri

#: Decisions by rising severity.
DECISIONS = ("allow", "warn", "block")
_KNOBS = {"fail_closed", "fail_open", "skip"}
LEAVES = ("change", "meta", "inferred_meta", "config", "structural")
_PARTS = ("all", "any", "not", "field", "reach", *LEAVES)
#: Fields of a change, facts, kinds of reached objects, and the meanings that count as breaking.
FIELDS, FACTS, KINDS = ("kind", "semantic", "breaking", "model", "column"), ("provable_test_break", "touches_exposure", "reaches_anything"), ("model", "column", "exposure")
BREAKING = ("meaning_changed", "indeterminate")


def check(policy: dict) -> dict:
    """The policy, or a ValueError that says what is wrong with it."""
    if policy.get("version") != 1:
        raise ValueError(f"policy version must be 1, not {policy.get('version')!r}")
    for rule in policy.get("rules", []):
        if rule.get("decision") not in DECISIONS:
            raise ValueError(f"rule {rule.get('name')!r}: decision must be one of {DECISIONS}")
        for knob in ("on_missing_meta", "on_error"):
            if rule.get(knob, "fail_closed") not in _KNOBS:
                raise ValueError(f"rule {rule.get('name')!r}: {knob} must be one of {sorted(_KNOBS)}")
        _shape(rule.get("when"), rule.get("name"))
    return policy


def _shape(p, name) -> None:
    kinds = [k for k in _PARTS if isinstance(p, dict) and k in p]
    if len(kinds) != 1:
        raise ValueError(f"rule {name!r}: a predicate has exactly one of {', '.join(_PARTS)}")
    kind = kinds[0]
    for x in p[kind] if kind in ("all", "any") else [p["not"]] if kind == "not" else []:
        _shape(x, name)
    if kind in ("change", "meta", "inferred_meta", "config"):
        leaf = p[kind]
        meta.check_operator(leaf["op"], leaf.get("value"))
        if kind == "change" and leaf["field"] not in FIELDS:
            raise ValueError(f"rule {name!r}: a change has no field {leaf['field']!r}")
    if kind == "structural" and p[kind].get("fact") not in FACTS:
        raise ValueError(f"rule {name!r}: fact must be one of {FACTS}")
    if kind == "reach":
        if p["reach"].get("min_count", 1) < 1:
            raise ValueError(f"rule {name!r}: min_count must be at least 1")
        if "where" in p["reach"]:
            if p["reach"].get("kind", KINDS[0]) not in KINDS:
                raise ValueError(f"rule {name!r}: reach kind must be one of {KINDS}")
            _shape(p["reach"]["where"], name)


def compile_predicate(p: dict, malformed: dict[str, Column] | None = None) -> tri.Tri:
    """The predicate as a three-valued column over the subjects' fields.

    ``malformed`` says of a plain field when its value is there but of the wrong shape; that, and a value which gives the operator no
    answer, is an unknown by error.  A reach leaf with ``where`` reads the counts that ``with_reaches`` adds; one without reads
    n_true and n_unknown of ``with_reach``.
    """
    return _tree(p, lambda leaf: _subject_leaf(leaf, malformed or {}))


def _tree(p: dict, leaf) -> tri.Tri:
    if "all" in p:
        return tri.all_of(*(_tree(x, leaf) for x in p["all"]))
    if "any" in p:
        return tri.any_of(*(_tree(x, leaf) for x in p["any"]))
    if "not" in p:
        return tri.not_(_tree(p["not"], leaf))
    return leaf(p)


def leaves(p: dict, kind: str | None = None) -> list[dict]:
    """The leaves of a predicate from left to right, those inside a reach excluded."""
    found: list[dict] = []
    _tree(p, lambda x: found.append(x) or tri.Tri.of(F.lit(True)))
    return [x for x in found if kind is None or kind in x]


def _subject_leaf(p: dict, malformed: dict[str, Column]) -> tri.Tri:
    if "field" in p:
        value = F.col(p["field"])
        wrong = F.coalesce(malformed.get(p["field"], F.lit(False)), F.lit(False))
        plain = tri.compare(p["op"], value, p.get("value"))
        return tri.Tri(F.when(~wrong, plain), wrong | (value.isNotNull() & plain.isNull()))
    if "change" in p:
        meaning = F.coalesce("semantic", F.lit("indeterminate"))
        field = {"semantic": meaning, "breaking": meaning.isin(*BREAKING)}.get(p["change"]["field"])
        field = F.col(p["change"]["field"]) if field is None else field
        return meta.compare(p["change"]["op"], field.cast("variant"), p["change"].get("value"))
    if "structural" in p:
        fact = p["structural"]["fact"]
        if fact == "provable_test_break":
            return tri.Tri.of(F.coalesce("provable_break", F.lit(False)))
        counted = F.coalesce("n_exposures" if fact == "touches_exposure" else "n_reached", F.lit(0)) > 0
        return tri.Tri.of(F.when(F.col("resolved"), counted))
    if "reach" in p:
        reach = p["reach"]
        if "where" not in reach or "op" in reach["where"]:
            return tri.Tri.of(quantified(F.col("n_true"), F.col("n_unknown"), reach.get("min_count", 1)))
        n = F.col(_reach_name(reach))
        count = lambda c: F.coalesce(n[c], F.lit(0))
        value = F.when(F.col("resolved"), quantified(count("n_true"), count("n_unknown"), reach.get("min_count", 1)))
        return tri.Tri(value, F.coalesce(F.col("resolved"), F.lit(False)) & value.isNull() & (count("n_error") > 0))
    if "meta" in p:
        return _keyed(p, meta.compare, lambda key: meta.first_of(meta.lookup(F.col("column_meta"), key), meta.lookup(F.col("model_meta"), key)))
    if "inferred_meta" in p:
        return _keyed(p, meta.compare_inferred, lambda key: meta.inferred_lookup(F.col("column_meta"), F.col("inferred"), key))
    return _keyed(p, meta.compare_config, lambda key: meta.lookup(F.col("config"), key))


def _keyed(p: dict, compare, lookup) -> tri.Tri:
    (leaf,) = p.values()
    return compare(leaf["op"], lookup(leaf["key"]), leaf.get("value"))


def _reached_leaf(p: dict) -> tri.Tri:
    kind = F.col("reached_kind")
    if "meta" in p:
        shown = lambda key: meta.exposure_lookup(F.col("name"), F.col("type"), F.col("owner"), F.col("meta"), key, F.col("dashboard"), F.col("dashboard").isNotNull())
        return _keyed(p, meta.compare, lambda key: F.when(kind == "exposure", shown(key)).otherwise(meta.lookup(F.col("meta"), key)))
    if "inferred_meta" in p:
        return _keyed(p, meta.compare_inferred, lambda key: F.when(kind == "column", meta.inferred_lookup(F.col("meta"), F.col("inferred"), key)))
    if "config" in p:
        return _keyed(p, meta.compare_config, lambda key: F.when(kind != "exposure", meta.lookup(F.col("config"), key)))
    # nothing else can be asked of a reached object
    return tri.Tri(F.lit(None).cast("boolean"), F.lit(True))


def _reach_name(reach: dict) -> str:
    return "reach_" + hashlib.sha256(json.dumps(reach, sort_keys=True, default=str).encode()).hexdigest()[:16]


def with_reaches(policy: dict, subjects: DataFrame, reached: DataFrame, keys: list[str]) -> DataFrame:
    """Subjects with n_true, n_unknown and n_error of each reach leaf of the policy, all counted in one pass over what they reach."""
    found = {_reach_name(x["reach"]): x["reach"] for r in policy["rules"] for x in leaves(r["when"], "reach") if "where" in x["reach"]}
    if not found:
        return subjects
    counts = []
    for name, reach in found.items():
        asked = F.col("reached_kind") == reach.get("kind", KINDS[0])
        if reach.get("mechanism"):
            asked = asked & (F.col("reached_kind") != "exposure") & F.coalesce(F.col("mechanism").isin(*reach["mechanism"]), F.lit(False))
        inner = _tree(reach["where"], _reached_leaf)
        unknown = asked & inner.value.isNull()
        counts.append(F.struct(F.count_if(asked & inner.value).alias("n_true"), F.count_if(unknown).alias("n_unknown"), F.count_if(unknown & inner.error).alias("n_error")).alias(name))
    return subjects.join(reached.groupBy(*keys).agg(*counts), keys, "left")


def aggregate_outcome(policy: dict, rule: dict, subjects: DataFrame) -> DataFrame:
    """One row (rule, outcome, cause, decision) of a rule over the whole changeset: each leaf holds if it does for some change."""
    found = leaves(rule["when"])
    tris = [_subject_leaf(x, {}) for x in found]
    counts = [F.struct(F.count_if(t.value).alias("n_true"), F.count_if(t.value.isNull()).alias("n_unknown"), F.count_if(t.value.isNull() & t.error).alias("n_error")).alias(f"l{i}") for i, t in enumerate(tris)]
    some = iter([tri.Tri(quantified(F.col(f"l{i}.n_true"), F.col(f"l{i}.n_unknown"), 1), (F.col(f"l{i}.n_true") == 0) & (F.col(f"l{i}.n_error") > 0)) for i in range(len(found))])
    value = _tree(rule["when"], lambda _: next(some))
    row = subjects.agg(*counts) if counts else subjects.sparkSession.range(1)
    return row.select(F.lit(rule["name"]).alias("rule"), _outcome(policy, rule, value).alias("outcome"), value.cause().alias("cause"), F.lit(rule["decision"]).alias("decision"))


def _outcome(policy: dict, rule: dict, value: tri.Tri) -> Column:
    d = policy.get("defaults", {})
    knob = lambda k: rule.get(k, d.get(k, "fail_closed"))
    return tri.resolve(value, knob("on_missing_meta"), knob("on_error"), rule["decision"] == "block", d.get("warn_rules_fire_on_unknown", False))


def semantic_default_hits(policy: dict, changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, outcome, cause, decision: what ``defaults.on_meaning_changed`` and ``on_indeterminate`` ask for.

    Only changes that have a meaning take part; a knob that is not set, or is allow, asks for nothing.
    """
    defaults = policy.get("defaults", {})
    asked = {m: defaults.get(f"on_{m}") for m in BREAKING if defaults.get(f"on_{m}") not in (None, "allow")}
    decision = reduce(lambda c, kv: F.when(F.col("semantic") == kv[0], kv[1]).otherwise(c), asked.items(), F.lit(None).cast("string"))
    hits = changes.where(F.col("semantic").isin(*asked)) if asked else changes.limit(0)
    return hits.select(*keys, F.concat(F.lit("builtin:on_"), "semantic").alias("rule"), F.lit("fire").alias("outcome"), F.lit("true").alias("cause"), decision.alias("decision"))


def quantified(n_true: Column, n_unknown: Column, at_least: int) -> Column:
    """True with enough proven objects, unknown if unknown ones could make up the number, else false."""
    return F.when(n_true >= at_least, True).when(n_true + n_unknown >= at_least, F.lit(None).cast("boolean")).otherwise(False)


def with_reach(subjects: DataFrame, reached: DataFrame, leaf: tri.Tri, keys: list[str]) -> DataFrame:
    """Adds n_true, n_unknown and n_error of a leaf over what each subject reaches."""
    counts = reached.withColumn("_v", leaf.value).withColumn("_e", leaf.error).groupBy(*keys).agg(F.count_if("_v").alias("n_true"), F.count_if(F.col("_v").isNull()).alias("n_unknown"), F.count_if(F.col("_v").isNull() & F.col("_e")).alias("n_error"))
    return subjects.join(counts, keys, "left").fillna(0, ["n_true", "n_unknown", "n_error"])


def aggregate_leaf(value: Column) -> Column:
    """Whether some subject satisfies a leaf: true, unknown if some can't be told, else false."""
    return F.when(F.bool_or(value), True).when(F.bool_or(value.isNull()), F.lit(None).cast("boolean")).otherwise(False)


def evaluate(policy: dict, subjects: DataFrame, keys: list[str], malformed: dict[str, Column] | None = None) -> DataFrame:
    """keys, rule, outcome (fire or dropped), cause and decision: a row per rule that fires on, or drops, a subject.

    The subjects are read once for all rules.
    """
    check(policy)
    hits = []
    for rule in policy["rules"]:
        if rule.get("scope", "change") == "change":
            value = compile_predicate(rule["when"], malformed)
            hits.append(F.struct(F.lit(rule["name"]).alias("rule"), _outcome(policy, rule, value).alias("outcome"), value.cause().alias("cause"), F.lit(rule["decision"]).alias("decision")))
    return subjects.select(*keys, F.explode(F.array(*hits)).alias("h")).select(*keys, "h.*").where("outcome <> 'quiet'")


def severity(decision: Column) -> Column:
    return reduce(lambda c, kv: F.when(decision == kv[1], kv[0]).otherwise(c), enumerate(DECISIONS), F.lit(0))


def combine(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The most severe decision per subject that has a hit."""
    worst = F.max(severity(F.col("decision")))
    return hits.where("outcome = 'fire'").groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, DECISIONS)), worst + 1).alias("decision"), F.count("*").alias("n_hits"))


def cap(decision: Column, verb: Column, provable: Column, aggregate: Column) -> Column:
    """A hit's decision under an override: allow-break turns a block into a warning, allow-change lifts it unless a break is proven; aggregate hits stay."""
    lifted = F.when((decision == "block") & provable, "block").otherwise("allow")
    return F.when(aggregate | verb.isNull(), decision).when((verb == "break") & (decision == "block"), "warn").when(verb == "change", lifted).otherwise(decision)


def apply_overrides(hits: DataFrame, overrides: DataFrame, breaks: DataFrame, keys: list[str], aggregate: Column | None = None) -> DataFrame:
    """Hits that fired, with their decision under the override of their change: verb, was (the decision before) and overridden added.

    ``overrides`` has keys and verb, one a change; ``breaks`` keys of provable breaks.  Hits of aggregate rules (``aggregate``) belong to no
    change and stay.
    """
    own = overrides.select(*keys, "verb").join(breaks.select(*keys).distinct().withColumn("_break", F.lit(True)), keys, "left")
    out = hits.where("outcome = 'fire'").join(own, keys, "left").withColumnRenamed("decision", "was")
    now = cap(F.col("was"), F.col("verb"), F.coalesce("_break", F.lit(False)), F.lit(False) if aggregate is None else F.coalesce(aggregate, F.lit(False)))
    return out.withColumn("decision", now).withColumn("overridden", F.col("decision") != F.col("was")).drop("_break")


def override_records(capped: DataFrame, overrides: DataFrame, breaks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verb, effect (applied or ineffective), rule, was, decision, on_break: what became of every override.

    One that lowered hits has a row for each of them; one that lowered none has one row, so that it isn't silently passed over.
    """
    broken = breaks.select(*keys).distinct().withColumn("on_break", F.lit(True))
    lowered = capped.where("overridden").select(*keys, "rule", "was", "decision")
    out = overrides.select(*keys, "verb").join(lowered, keys, "left").join(broken, keys, "left")
    effect = F.when(F.col("rule").isNotNull(), "applied").otherwise("ineffective")
    return out.select(*keys, "verb", effect.alias("effect"), "rule", "was", "decision", F.coalesce("on_break", F.lit(False)).alias("on_break"))


def build_set(hits: DataFrame, reached: DataFrame, keys: list[str], mechanisms: list[str] | None = None) -> DataFrame:
    """The distinct nodes that fired subjects reach, by the given mechanisms only."""
    wanted = reached if mechanisms is None else reached.where(F.col("mechanism").isin(mechanisms))
    return wanted.join(hits.where("outcome = 'fire'").select(*keys).distinct(), keys, "left_semi").select("node").distinct()


def rule_stats(fired: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, n_points, n_hits, n_unknown and flag: DEAD if it never fired, FAIL-SAFE ONLY if it only did on unknowns."""
    stats = fired.groupBy("rule").agg(F.count_distinct("point").alias("n_points"), F.count("*").alias("n_hits"), F.count_if(F.col("cause") != "true").alias("n_unknown"))
    flag = F.when(F.col("n_hits") == 0, "DEAD").when(F.col("n_hits") == F.col("n_unknown"), "FAIL-SAFE ONLY").otherwise("")
    return rules.join(stats, "rule", "left").fillna(0, ["n_points", "n_hits", "n_unknown"]).withColumn("flag", flag)


def selection_stats(points: DataFrame) -> DataFrame:
    """One row over points (n_rebuild, n_total, widened): points, widened ones, median and mean share rebuilt."""
    share = F.col("n_rebuild") / F.col("n_total")
    return points.agg(F.count("*").alias("n_points"), F.count_if("widened").alias("n_widened"), F.round(F.median(share), 6).alias("median_share"), F.round(F.avg(share), 6).alias("mean_share"))


def baseline_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """rule, n_current, n_baseline, delta of every rule on either side."""
    both = current.select("rule", F.col("n_hits").alias("n_current")).join(baseline.select("rule", F.col("n_hits").alias("n_baseline")), "rule", "full_outer").fillna(0)
    return both.withColumn("delta", F.col("n_current") - F.col("n_baseline"))


def key_coverage(meta: DataFrame, column: str) -> DataFrame:
    """key, n and pct: how often each top-level key occurs in a JSON object column."""
    keys = meta.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    total = F.broadcast(meta.agg(F.count("*").alias("total")))  # one row
    return keys.join(total, F.lit(True)).select("key", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))
