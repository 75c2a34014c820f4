"""From profile facts to decisions, a preparation plan, and the prepared table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.frame import dtype_of, is_numeric
from ..operators.profile import TableProfile, feature_families, infer_task_type, scale_name, width_name
from .steps import apply_step

STAGES = ["drop", "parse", "encode", "transform", "engineer"]


def decide(p: TableProfile) -> list[tuple[str, str, str]]:
    """(column, stage, action); the first rule that fits a column counts."""
    drops = [(set(p.fully_missing), "fully missing"), (set(p.constant), "constant"), (set(p.id_like), "identifier"),
             (set(p.special["names"]), "personal name"), (set(p.leakage), "leakage")]
    dates = dict(p.special["dates"])
    out = []
    for c in p.df.columns:
        if c == p.target:
            continue
        reason = next((why for names, why in drops if c in names), None)
        if reason:
            out.append((c, "drop", reason))
        elif c in dates:
            out.append((c, "parse", "date parts with hour" if dates[c] == "timestamp" else "date parts with tenure"))
        elif c in p.special["texts"]:
            out.append((c, "parse", "tf-idf"))
        elif p.roles.get(c) in ("binary", "categorical"):
            d = p.base[c]["distinct"]
            how = "binary" if p.roles[c] == "binary" else "one-hot" if d <= 10 else "target" if d <= 50 else "hash"
            out.append((c, "encode", how + (" after grouping rare" if c in p.rare else "")))
        elif c in p.roles:
            skew, out_heavy = c in p.skewed, c in p.outliers
            out.append((c, "transform", "log + robust" if skew and out_heavy else "log" if skew else "robust" if out_heavy else "z-score"))
    gone = {c for c, stage, _ in out if stage == "drop"}
    for stem, members in feature_families(p.features).items():
        left = [m for m in members if m not in gone]
        if len(left) >= 2:
            out.append((",".join(left), "engineer", f"deltas and ratios of {stem}"))
    if len(dates) >= 2:
        out.append((",".join(sorted(dates)), "engineer", "date differences"))
    return out


def prep_decisions(p: TableProfile) -> DataFrame:
    return p.frame(decide(p), "column string, stage string, action string")


def preparation_plan(p: TableProfile) -> dict:
    """Task, metrics, validation and ordered steps: drops, fills, derived columns, rare grouping, scaling, encoding."""
    task = infer_task_type(p.df, p.target)
    decisions = decide(p)
    dropped = {c for c, stage, _ in decisions if stage == "drop"}
    steps: list[dict] = [{"name": f"drop {c}", "type": "transformation", "category": "delete", "column": c, "reason": why} for c, stage, why in decisions if stage == "drop"]
    for c, f in p.base.items():
        if c in dropped or c == p.target or not f["missing"]:
            continue
        if f["missing"] / max(p.rows, 1) > 0.4:
            steps.append({"name": f"drop {c}", "type": "transformation", "category": "delete", "column": c, "reason": "more than 40 % missing"})
            dropped.add(c)
        else:
            how = "median" if is_numeric(dtype_of(p.df, c)) else "mode"
            steps.append({"name": f"fill {c}", "type": "cleaning", "category": "Null handling", "strategies": {c: how}})
    steps += feature_steps(p, decisions, dropped)
    by: dict[str, list[str]] = {}
    rare = []
    for c, stage, action in decisions:
        if c in dropped or stage not in ("transform", "encode"):
            continue
        kind = action.replace(" after grouping rare", "")
        if kind != action:
            rare.append(c)
        by.setdefault(kind, []).append(c)
    if rare:
        steps.append({"name": "group rare", "type": "encoding", "category": "Group Rare", "columns": rare})
    logs = by.get("log", []) + by.get("log + robust", [])
    if logs:
        steps.append({"name": "log", "type": "transformation", "category": "log", "columns": logs})
    robust = by.get("robust", []) + by.get("log + robust", [])
    for name, category, cols in (("robust", "Robust Scaler", robust), ("z-score", "Z-score Standardization", by.get("z-score", [])),
                                 ("one-hot", "one-hot encoding", by.get("one-hot", [])), ("hash", "Hash Encoding", by.get("hash", []))):
        if cols:
            steps.append({"name": name, "type": "encoding" if "ncod" in category else "standardization", "category": category, "columns": cols})
    if by.get("binary"):
        steps.append({"name": "binary", "type": "encoding", "category": "Label Encoding", "columns": by["binary"]})
    if by.get("target"):
        usable = p.target and is_numeric(dtype_of(p.df, p.target))
        steps.append({"name": "target", "type": "encoding", "category": "Target Encoding" if usable else "Frequency Encoding", "columns": by["target"], "target": p.target})
    metrics = ["auc", "f1"] if task == "Classification" else ["rmse", "mae", "r2"]
    return {"task_type": task, "target": p.target, "metrics": metrics, "steps": steps,
            "validation": "stratified 5-fold" if task == "Classification" else "5-fold"}


def feature_steps(p: TableProfile, decisions: list[tuple[str, str, str]], dropped: set[str]) -> list[dict]:
    """Derived columns of the decisions, before anything is scaled: dates parsed and compared, family deltas, date parts, text weights."""
    steps: list[dict] = []
    dates = [(c, action) for c, stage, action in decisions if stage == "parse" and action.startswith("date parts") and c not in dropped and not is_numeric(dtype_of(p.df, c))]
    texts = [c for c, _ in dates if c in p.kinds["text"]]
    if texts:
        steps.append({"name": "parse dates", "type": "cleaning", "category": "Date Validation", "date_columns": texts, "columns": texts, "action": "validate"})
    for columns, stage, action in decisions:
        if stage != "engineer":
            continue
        members = [c for c in columns.split(",") if c not in dropped]
        if action == "date differences":
            members = [c for c in members if c in dict(dates)]
            category = "Date Differences"
        else:
            members = [c for c in members if is_numeric(dtype_of(p.df, c))]
            category = "Family Deltas"
        if len(members) >= 2:
            steps.append({"name": action, "type": "feature", "category": category, "columns": members})
    steps += [{"name": f"date parts of {c}", "type": "feature", "category": "Date Parts", "column": c, "with_time": action.endswith("hour")} for c, action in dates]
    steps += [{"name": f"tf-idf of {c}", "type": "feature", "category": "Text TF-IDF", "column": c} for c, stage, action in decisions if stage == "parse" and action == "tf-idf" and c not in dropped]
    return steps


def plan_table(p: TableProfile) -> DataFrame:
    """(position, name, category, columns) of the plan."""
    plan = preparation_plan(p)
    rows = []
    for i, s in enumerate(plan["steps"]):
        cols = s.get("columns") or list(s.get("strategies", {})) or [s.get("column")]
        rows.append((i, s["name"], s["category"], ",".join(cols)))
    return p.frame(rows, "position int, name string, category string, columns string")


def fused(steps: list[dict]) -> list[list[dict]]:
    """Neighbouring fills of different columns in one group: together they need one fit, and none sees another's result."""
    groups: list[list[dict]] = []
    for s in steps:
        simple = s["category"] == "Null handling" and "knn" not in s["strategies"].values()
        last = groups[-1] if groups else []
        if simple and last and last[0]["category"] == "Null handling" and "knn" not in last[0]["strategies"].values() and not any(set(s["strategies"]) & set(x["strategies"]) for x in last):
            last.append(s)
        else:
            groups.append([s])
    return groups


def run_plan(df: DataFrame, plan: dict, on_error: str = "raise") -> tuple[DataFrame, list[tuple[str, str]]]:
    """The prepared table and the log (step, outcome).  All fills that follow each other are fitted together."""
    log = []
    for group in fused(plan["steps"]):
        if len(group) > 1:
            group = [{**group[0], "strategies": {c: x for s in group for c, x in s["strategies"].items()}, "names": [s["name"] for s in group]}]
        for s in group:
            names = s.get("names", [s["name"]])
            try:
                df = apply_step(df, s)
                log += [(n, "done") for n in names]
            except Exception as error:
                if on_error == "raise":
                    raise
                log += [(n, f"failed: {error}") for n in names]
    return df, log


def quality_report(p: TableProfile) -> DataFrame:
    """(fact, subject, value): the findings of the profile as rows, without prose."""
    rows = [("scale", None, scale_name(p.rows)), ("rows", None, str(p.rows)),
            ("numeric features", None, str(len(p.numeric_features))), ("categorical features", None, str(len(p.features) - len(p.numeric_features))),
            ("dimensionality", None, width_name(len(p.features)))]
    rows += [("correlated cluster", str(i + 1), ",".join(g)) for i, g in enumerate(p.clusters)]
    rows += [("missing", c, str(f["missing"])) for c, f in p.base.items() if f["missing"]]
    rows.append(("duplicates", None, str(p.duplicates)))
    for fact, names in (("outliers", p.outliers), ("constant", p.constant), ("identifier", p.id_like), ("leakage", p.leakage),
                        ("rare categories", sorted(p.rare)), ("date", sorted(c for c, _ in p.special["dates"])), ("text", p.special["texts"])):
        rows += [(fact, c, "yes") for c in names]
    rows += [("high cardinality", c, str(p.base[c]["distinct"])) for c in p.text_features if p.base[c]["distinct"] > 20]
    if p.target:
        rows.append(("imbalance", p.target, p.imbalance))
    return p.frame(rows, "fact string, subject string, value string")
