"""Reports from small aggregates; facts stay in tables."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.risk import LEVELS, severity, to_date

TOP, DEEP = 20, 10
BINS = "1-5 6-10 11-15 16-20 21-25 26-30 31+".split()


def build_report(risks: DataFrame, evidence: DataFrame, name: str, cutoff: str = "2024-03-15") -> dict:
    """Summary, levels, hits in bins, times, the worst instances and counts of evidence. Only aggregates and TOP rows reach the driver."""
    risks = risks.persist()
    total = risks.count()
    levels = {r[0]: r[1] for r in risks.groupBy("risk").count().collect()}
    kinds = {r[0]: r[1] for r in evidence.groupBy("match_type").count().orderBy("match_type").collect()}
    columns = set(risks.columns)
    hits = F.col("independent_hits") if "independent_hits" in columns else F.lit(0)
    bins = {r[0]: r[1] for r in risks.where(hits > 0).groupBy(F.least(F.floor((hits - 1) / 5), F.lit(6)).cast("int")).count().collect()}
    day = to_date(F.col("merge_date")) if "merge_date" in columns else F.lit(None).cast("date")
    edge = F.lit(cutoff).cast("date")
    times = risks.agg(F.count_if(day < edge).alias("before"), F.count_if(day >= edge).alias("after"), F.count_if(day.isNull()).alias("unknown")).first().asDict()
    deep = risks.where(hits > 0).orderBy(F.desc(hits), F.desc(severity(F.col("risk"))), "instance_id").limit(DEEP).select("instance_id", "repo", "risk", hits.alias("hits")).collect()
    worst = risks.orderBy(F.desc(severity(F.col("risk"))), F.desc("patch_exposure"), "instance_id").limit(TOP)
    flagged = sum(n for k, n in levels.items() if k != "clean")
    return {
        "name": name,
        "total": total,
        "not_evaluated": risks.where("not_evaluated").count(),
        "levels": {k: levels.get(k, 0) for k in LEVELS},
        "flagged_rate": round(flagged / total, 6) if total else 0.0,
        "evidence": kinds,
        "histogram": {b: bins.get(i, 0) for i, b in enumerate(BINS)},
        "times": times | {"cutoff": cutoff},
        "deep": [r.asDict() for r in deep],
        "top": [r.asDict() for r in worst.select("instance_id", "repo", "risk", "patch_exposure").collect()],
    }


def findings(report: dict) -> list[dict]:
    """What the numbers say, each with the section it belongs to and how sure it is (high, medium, low)."""
    total, levels, kinds = report["total"], report["levels"], report["evidence"]
    if not total:
        return []
    out: list[dict] = []
    add = lambda section, sure, text: out.append({"section": section, "confidence": sure, "text": text})
    if report["not_evaluated"]:
        add("scope", "high", f"{report['not_evaluated']} of {total} instances had no source to compare with.")
    grave = levels["critical"] + levels["high"]
    if grave:
        share = grave / total
        add("risk", "high" if share >= 0.5 else "medium" if share >= 0.25 else "low", f"{grave} of {total} instances are of level high or critical.")
    if n := kinds.get("patch_verbatim", 0):
        add("source", "high", f"{n} patches stand in their source word for word.")
    if n := kinds.get("repo_in_training_corpus", 0):
        add("corpus", "medium", f"{n} instances belong to repositories of the corpus.")
    if n := kinds.get("embedding_similarity_hit", 0):
        add("paraphrase", "low", f"{n} patches resemble their source without sharing its wording.")
    if n := kinds.get("test_patch_near_duplicate", 0):
        add("tests", "medium", f"{n} test patches are close to the source.")
    if levels["clean"] == total:
        add("risk", "medium", "No instance bears a signal.")
    return out


def limitations(report: dict) -> list[str]:
    """What the numbers don't say."""
    out = ["Availability of a text is measured here; what a model remembers of it is not."]
    times = report.get("times", {})
    if times.get("unknown"):
        out.append(f"The merge date of {times['unknown']} instances is unknown, so no cutoff was applied to them.")
    if report["not_evaluated"]:
        out.append(f"{report['not_evaluated']} instances had no source; they count as clean unless copies or content say otherwise.")
    if report.get("dropped"):
        out.append(f"{report['dropped']} instances were lost to errors and aren't in the totals.")
    return out


def recommendations(report: dict) -> list[str]:
    """What to do about it, by what was found."""
    levels, kinds, out = report["levels"], report["evidence"], []
    if levels["critical"] + levels["high"]:
        out.append("Report scores with and without the instances of level high or critical.")
    if kinds.get("independent_source_hit"):
        out.append("Look at the copies in other repositories by hand: they don't follow from the source itself.")
    if kinds.get("embedding_similarity_hit"):
        out.append("Compare reworded patches with their sources before counting them.")
    if report["not_evaluated"]:
        out.append("Fetch the missing sources and audit these instances again.")
    return out or ["Nothing needs to be done."]


def safe_url(url: str | None) -> str:
    """The address if it is an absolute http or https one without blanks or control characters, else ''."""
    u = (url or "").strip()
    return u if re.fullmatch(r"https?://[^\s\x00-\x1f<>\"'`]+", u, re.I) else ""


def summary_lines(report: dict) -> list[str]:
    """A few lines for a terminal."""
    if not report["total"]:
        return [f"{report['name']}: nothing was audited"]
    return [f"{report['name']}: {report['total']} instances, {report['flagged_rate']:.1%} flagged, {report['not_evaluated']} not evaluated", *[f"  {k:<9}{n}" for k, n in report["levels"].items()]]


def write_json(report: dict, path: str | Path) -> Path:
    path = Path(path)
    path.write_text(json.dumps(report, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    return path


def read_json(path: str | Path) -> dict:
    report = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = {"name", "total", "levels", "top"} - set(report)
    if missing:
        raise ValueError(f"not a report: {sorted(missing)} missing")
    return report


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The worst instances of many reports as a table."""
    return spark.read.option("multiLine", True).json(path).select("name", F.explode("top").alias("t")).select("name", "t.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, changed, name, total, flagged_rate) of all reports under a path, the newest first."""
    r = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    return r.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), "name", "total", "flagged_rate").where("total is not null").orderBy(F.desc("changed"), "file")


def _cell(x) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def markdown(report: dict) -> str:
    if not report["total"]:
        return f"# {report['name']}\n\nNothing was audited.\n"
    out = [f"# {report['name']}", "", f"{report['total']} instances, of which {report['not_evaluated']} could not be evaluated. {report['flagged_rate']:.1%} bear a signal.", "", "| level | instances |", "|---|---|"]
    out += [f"| {k} | {n} |" for k, n in report["levels"].items()]
    out += ["", "## Evidence", "", "| kind | rows |", "|---|---|", *[f"| {_cell(k)} | {n} |" for k, n in report["evidence"].items()]]
    out += ["", "## Findings", "", *[f"- {f['text']} ({f['confidence']})" for f in findings(report)]]
    out += ["", "## Most exposed", "", "| instance | repository | level | exposure |", "|---|---|---|---|"]
    out += [f"| {_cell(t['instance_id'])} | {_cell(t['repo'])} | {t['risk']} | {t['patch_exposure']:.3f} |" for t in report["top"]]
    if any(report.get("histogram", {}).values()):
        out += ["", "## Independent hits", "", "| hits | instances |", "|---|---|", *[f"| {k} | {n} |" for k, n in report["histogram"].items()]]
    if t := report.get("times"):
        out += ["", "## Times", "", f"{t['before']} instances were merged before {t['cutoff']}, {t['after']} since; of {t['unknown']} the date is unknown."]
    if report.get("deep"):
        out += ["", "## Most copied", "", "| instance | repository | level | hits |", "|---|---|---|---|", *[f"| {_cell(d['instance_id'])} | {_cell(d['repo'])} | {d['risk']} | {d['hits']} |" for d in report["deep"]]]
    out += ["", "## Recommendations", "", *[f"- {x}" for x in recommendations(report)], "", "## Limits", "", *[f"- {x}" for x in limitations(report)]]
    return "\n".join(out) + "\n"


def page(report: dict) -> str:
    e = lambda x: html.escape(str(x))
    if not report["total"]:
        return f"<!doctype html><meta charset=utf-8><title>{e(report['name'])}</title><h1>{e(report['name'])}</h1><p>Nothing was audited.</p>\n"
    rows = "".join(f"<tr><td>{e(t['instance_id'])}<td>{e(t['repo'])}<td>{e(t['risk'])}<td>{t['patch_exposure']:.3f}" for t in report["top"])
    top = max(report["levels"].values(), default=0) or 1
    bars = "".join(f"<tr><td>{k}<td>{n}<td><div style='background:#48c;height:.8em;width:{round(100 * n / top)}%'></div>" for k, n in report["levels"].items())
    section = lambda title, body: f"<h2>{title}</h2>{body}" if body else ""
    items = lambda xs: "<ul>" + "".join(f"<li>{e(x)}" for x in xs) + "</ul>" if xs else ""
    times = report.get("times")
    more = section("Independent hits", "<table>" + "".join(f"<tr><td>{k}<td>{n}" for k, n in report["histogram"].items()) + "</table>" if any(report.get("histogram", {}).values()) else "")
    more += section("Times", f"<p>{times['before']} before {e(times['cutoff'])}, {times['after']} since, {times['unknown']} unknown." if times else "")
    more += section("Most copied", "<table>" + "".join(f"<tr><td>{e(d['instance_id'])}<td>{e(d['repo'])}<td>{d['hits']}" for d in report["deep"]) + "</table>" if report.get("deep") else "")
    more += section("Findings", items([f["text"] for f in findings(report)])) + section("Recommendations", items(recommendations(report))) + section("Limits", items(limitations(report)))
    return f"<!doctype html><meta charset=utf-8><title>{e(report['name'])}</title><h1>{e(report['name'])}</h1><p>{report['total']} instances, {report['not_evaluated']} not evaluated.</p><table style='width:30em'>{bars}</table><h2>Most exposed</h2><table>{rows}</table>{more}\n"


def write_markdown(report: dict, path: str | Path) -> Path:
    Path(path).write_text(markdown(report), encoding="utf-8")
    return Path(path)


def write_html(report: dict, path: str | Path) -> Path:
    Path(path).write_text(page(report), encoding="utf-8")
    return Path(path)
