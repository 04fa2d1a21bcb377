"""Merge, resolve and prune over files: the functions behind ``python -m kinfold``.

A merge reads two exports and writes merged cards, cards for review and a JSON report; decisions are a JSON-lines file
(``cluster_id``, ``decision``) that any tool can write; a review writes the state that they leave into the report; a resolve
applies the report to the written files. A run does all of it and stops where decisions are missing.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold import model as M
from kinfold.functions import text as X
from kinfold.operators import clustering, prune, reporting, review, scoring, survivorship
from kinfold.plans.resolution import Resolution
from kinfold.plans.storage import materialize
from kinfold.sources import logs, vcard


def path_key(path: str) -> str:
    return os.path.realpath(path).casefold()


def check_distinct_paths(inputs: list[str], outputs: list[str]) -> None:
    """No output may be an input, another output, or the name that another one is staged under."""
    seen = {path_key(p): p for p in inputs}
    for out in outputs:
        for name in (out, out + ".tmp"):
            if path_key(name) in seen:
                raise ValueError(f"{out} and {seen[path_key(name)]} are the same file")
            seen[path_key(name)] = out


def _staged(path: str, parts: Iterator[str]) -> None:
    """Text, part by part, beside its target and then renamed over it; nothing is left behind if it fails."""
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    handle, staged = tempfile.mkstemp(prefix=f".{os.path.basename(path)}.", suffix=".tmp", dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(parts)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, path)
    except BaseException:
        if os.path.exists(staged):
            os.unlink(staged)
        raise


def write_json(value: object, path: str) -> None:
    _staged(path, iter([json.dumps(value, ensure_ascii=False, indent=2, default=str), "\n"]))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON object with a list a section (``summary``: its only row); rows come to the driver partition by partition."""

    def parts() -> Iterator[str]:
        for n, (name, df) in enumerate(sections.items()):
            yield ("{" if n == 0 else ",") + f"\n {json.dumps(name)}: " + ("" if name == "summary" else "[")
            for i, r in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
                yield (",\n  " if i else "") + json.dumps(json.loads(r["j"]), ensure_ascii=False)
            yield "" if name == "summary" else "]"
        yield "\n}\n"

    _staged(path, parts())


def same_file(a: str, b: str) -> bool:
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def copy_file(source: str, target: str) -> bool:
    """Copy over a target that is another file; without a source a stale target goes. Whether there was one."""
    if not os.path.exists(source):
        if os.path.exists(target):
            os.remove(target)
        return False
    if not same_file(source, target):
        shutil.copyfile(source, target)
    return True


def load_exports(spark: SparkSession, icloud: str, google: str) -> tuple[DataFrame, DataFrame]:
    """Contacts of both exports, icloud's first, and the warnings."""
    parsed = [(vcard.parse_files(spark, p, s), s) for p, s in ((icloud, "icloud"), (google, "google"))]
    warned = [vcard.warnings(p).withColumn("source", F.lit(s)) for p, s in parsed]
    return vcard.concat_sources(*(vcard.contacts(p) for p, _ in parsed)), warned[0].unionByName(warned[1])


def report_sections(r: Resolution) -> dict[str, DataFrame]:
    """The report, a DataFrame a section. What belongs to a cluster but is not bounded by one merge (its contacts, conflicts
    and pairs in words) stands in sections of its own, a row each; a cluster's row has its best pair."""
    ids = clustering.cluster_ids(r.placed, r.contacts)
    best = reporting.best_pairs(r.summary)
    columns = ["cluster", "cluster_id", "size", "score", "min_score", "name_similarity", *scoring.FLAGS]
    shown = best.join(ids, "cluster").join(r.summary.select("cluster", "size", "min_score", "auto"), "cluster").join(review.breakdown(best), "cluster").select(*columns, "auto", F.col("short").alias("why"))
    named = r.contacts.select("idx", "source", X.display_name().alias("name"))
    who = r.placed.join(named, "idx").join(ids, "cluster").join(r.summary.select("cluster", "auto"), "cluster").select("cluster_id", "idx", "source", "name", "auto")
    order = [F.desc("score"), "cluster_id"]
    return {
        "summary": r.totals, "merges": shown.where("auto").drop("auto").orderBy(*order), "reviews": shown.where("not auto").drop("auto").withColumn("decision", F.lit(review.PENDING)).orderBy(*order),
        "members": who.orderBy("cluster_id", "idx"), "conflicts": r.conflicts.join(ids, "cluster").select("cluster_id", "field", "icloud", "other").orderBy("cluster_id", "field"),
        "ambiguity": reporting.ambiguity_rows(r.rows, r.review_members, r.contacts).join(ids, "cluster").select("cluster_id", "a", "b", "said").orderBy("cluster_id", "a", "b"),
        "deferred": review.deferred_entries(r.deferred, r.contacts).orderBy(F.desc("score"), F.element_at("side_a", 1)), "distinct": r.distinct.select("idx", "source", X.display_name().alias("name")).orderBy("idx"),
    }


def merge(spark: SparkSession, icloud: str, google: str, out: str, review_path: str, report: str) -> Resolution:
    check_distinct_paths([icloud, google], [out, review_path, report])
    contacts, warned = load_exports(spark, icloud, google)
    r = Resolution(contacts, warnings=warned.count())
    vcard.write_file(r.output, out)
    waiting = r.review_in_order
    if waiting.isEmpty():
        if os.path.exists(review_path) and is_review_file(review_path):
            os.remove(review_path)
    else:
        vcard.write_file(waiting, review_path, review=True)
    write_report(report_sections(r) | {"warnings": warned}, report)
    return r


def is_review_file(path: str) -> bool:
    """Whether every card in a file carries the review tag, so that it may be replaced."""
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    return text.count("BEGIN:VCARD") == text.count(f"{vcard.M.EXTENSION}-REVIEW:true") > 0


REPORT = "struct<reviews:array<struct<cluster_id:string,decision:string,score:double>>,members:array<struct<cluster_id:string,idx:int,source:string,auto:boolean>>>"


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """``position, cluster_id, decision, score, sources`` of a report's review clusters, in their order."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", REPORT, {"mode": "FAILFAST"}).alias("r"))
    reviews = whole.select(F.posexplode("r.reviews").alias("position", "c")).select("position", "c.*")
    members = whole.select(F.explode("r.members").alias("m")).select("m.*").where("not auto")
    listed = members.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "source"))), lambda x: x["source"]).alias("sources"))
    return reviews.join(listed, "cluster_id", "left").select("position", "cluster_id", "decision", "score", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def review_state(spark: SparkSession, report: str, decisions: str) -> DataFrame:
    """The report's review clusters with the decisions that a log leaves them; unknown clusters in the log are errors."""
    clusters, log = load_report(spark, report), logs.read(spark, decisions)
    unknown = log.select("cluster_id").distinct().join(clusters, "cluster_id", "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} cluster(s) of the decisions are not in the report")
    return review.decision_state(clusters, log)


def apply_decisions(spark: SparkSession, report: str, decisions: str) -> int:
    """Write the log's decisions into the report; how many clusters are still pending."""
    said = {r["cluster_id"]: r["decision"] for r in review_state(spark, report, decisions).select("cluster_id", "decision").toLocalIterator()}
    with open(report, encoding="utf-8") as f:
        value = json.load(f)
    for c in value["reviews"]:
        c["decision"] = said[c["cluster_id"]]
    write_json(value, report)
    return sum(d == review.PENDING for d in said.values())


def resolved(merged: DataFrame, cards: DataFrame, report: DataFrame) -> DataFrame:
    """The final contacts, with ``sources``: all merged ones; of each review cluster one contact where it is to be merged,
    none where it is skipped, else all of its cards. Cards keep the sources that they were written with."""
    placed = materialize(review.aligned(report, cards), "aligned")
    known = materialize(review.with_report_sources(cards, placed).withColumn("sources", review.provenance(F.col("source"), F.col("extra"))), "review-cards")
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    decided = placed.withColumn("size", size).withColumn("cluster", F.col("position"))
    joined = decided.where("decision = 'merge' and size > 1").select("idx", "cluster")
    one = survivorship.merge_clusters(joined, known, F.array_contains("sources", "icloud"))
    tags = [f"{M.EXTENSION}-{t}" for t in ("REVIEW", "SCORE", "CLUSTER")]
    one = one.withColumn("extra", F.map_filter("extra", lambda k, _: ~k.isin(tags)))
    stay = known.join(decided.where("(decision = 'merge' and size = 1) or decision not in ('merge', 'skip')").select("idx"), "idx", "left_semi")
    first = merged.withColumn("sources", review.provenance(F.col("source"), F.col("extra")))
    offset = first.agg(F.max("idx")).head()[0]
    columns = [*(f.name for f in M.CONTACT.fields), "sources"]
    late = one.select(*columns).unionByName(stay.select(*columns)).withColumn("idx", (F.col("idx") + ((-1 if offset is None else offset) + 1)).cast("int"))
    return first.select(*columns).unionByName(late)


def resolve(spark: SparkSession, report: str, review_path: str, merged: str, out: str) -> DataFrame:
    """Apply a report's decisions to the files of a merge and write the final cards."""
    check_distinct_paths([report, review_path, merged], [out])
    cards = vcard.read_vcards(spark, review_path, "review")
    final = resolved(vcard.read_vcards(spark, merged, "merged"), cards, load_report(spark, report))
    vcard.write_file(final, out)
    return final


class Paused(Exception):
    """A run that waits for decisions; ``workspace`` has its report, merged and review files."""

    def __init__(self, workspace: str, pending: int) -> None:
        super().__init__(f"{pending} cluster(s) are pending; workspace: {workspace}")
        self.workspace, self.pending = workspace, pending


def run(spark: SparkSession, icloud: str, google: str, out: str, decisions: str | None = None, report: str | None = None, keep: bool = False) -> int:
    """Merge, apply decisions, resolve; the number of review clusters. The workspace is kept if something fails or
    decisions are missing (``Paused``). The decisions are appended to ``calibration.jsonl`` beside ``out``; with ``keep``
    the merged and review files are copied there."""
    beside = os.path.dirname(os.path.abspath(out))
    log = os.path.join(beside, "calibration.jsonl")
    kept = [k for k in (os.path.join(beside, n) for n in ("merged.vcf", "review.vcf")) if keep and path_key(k) != path_key(out)]
    check_distinct_paths([icloud, google, *([decisions] if decisions else [])], [p for p in (out, report, log, *kept) if p])
    os.makedirs(beside, exist_ok=True)
    space = tempfile.mkdtemp(prefix="kinfold-run-")
    merged, cards, told = (os.path.join(space, n) for n in ("merged.vcf", "review.vcf", "report.json"))
    r = merge(spark, icloud, google, merged, cards, told)
    waiting = r.summary.where("not auto").count()
    if waiting:
        pending = apply_decisions(spark, told, decisions) if decisions else waiting
        if pending:
            raise Paused(space, pending)
        resolve(spark, told, cards, merged, out)
        with open(log, "a", encoding="utf-8") as f:
            f.writelines(x["value"] + "\n" for x in spark.read.text(decisions).toLocalIterator() if x["value"].strip())
    else:
        vcard.write_file(r.output, out)
        if keep and os.path.exists(log):
            os.remove(log)
    if report:
        copy_file(told, report)
    for target in kept:
        copy_file(os.path.join(space, os.path.basename(target)), target)
    shutil.rmtree(space)
    return waiting


def run_prune(spark: SparkSession, path: str, out: str | None, removed: str | None, channels: str = "email,phone,address", skip_malformed: bool = False) -> dict:
    """Split one export; both files are staged before the first is renamed, the removed one first."""
    by = tuple(prune.parse_channels(channels))
    parsed = vcard.parse_files(spark, path)
    warned = vcard.warnings(parsed).count()
    found = materialize(prune.split(vcard.contacts(parsed), by), "split")
    total = found.count()
    if not total:
        raise ValueError(f"{path} holds no vCards")
    if warned and out and not skip_malformed:
        raise ValueError(f"{warned} malformed card(s) would be lost")
    kept, gone = prune.kept(found), prune.removed(found)
    if out:
        removed = removed or f"{out.removesuffix('.vcf')}-removed.vcf"
        check_distinct_paths([path], [out, removed])
        staged = []
        try:
            for part, target in ((gone, removed), (kept, out)):
                staged.append((vcard.stage_file(part, target), target))
            for name, target in staged:
                os.replace(name, target)
        finally:
            for name, _ in staged:
                if os.path.exists(name):
                    os.unlink(name)
    detail = gone.select("idx", "name", *prune.presence())
    return {
        "total": total, "kept": kept.count(), "removed": gone.count(), "reachable_by": list(by), "dry_run": out is None, "out": out, "removed_path": removed if out else None,
        "removed_contacts": [json.loads(x) for x in detail.orderBy("idx").toJSON().collect()], "warning_count": warned, "warnings": [json.loads(x) for x in vcard.warnings(parsed).toJSON().collect()],
    }


def _or(names: list[str]) -> str:
    return " or ".join(names) if len(names) < 3 else ", ".join(names[:-1]) + f", or {names[-1]}"


def prune_text(result: dict) -> str:
    """A prune's result for a terminal."""
    gone = result["removed_contacts"]
    counts = [("with an email or phone that did not count", ("email", "phone")), ("with org or title", ("org", "title")), ("with URL", ("url",)), ("with birthday", ("birthday",))]
    has = [[n for n in ("email", "phone", "org", "title", "address", "url", "birthday", "note", "photo") if c[f"has_{n}"]] for c in gone]
    lines = ["Contact prune" + " (dry run)" * result["dry_run"], "━" * 39, f"Total contacts: {result['total']}", f"Reachable by {_or(result['reachable_by'])}: {result['kept']}", f"Unreachable: {result['removed']}"]
    lines += [f"  {label}: {sum(any(k in h for k in kinds) for h in has)}" for label, kinds in counts] + [f"  name only: {sum(not h for h in has)}"]
    if gone:
        lines += ["", "Unreachable contacts:", *(f"  {i}. {c['name']} — has: {', '.join(h) or 'name only'}" for i, (c, h) in enumerate(zip(gone, has, strict=True), 1))]
    if result["dry_run"]:
        return "\n".join([*lines, f"{result['removed']} contacts would be removed. Run again with --out kept.vcf to write both files.", ""])
    return "\n".join([*lines, f"Wrote {result['kept']} contacts -> {result['out']}", f"Wrote {result['removed']} contacts -> {result['removed_path']}", ""])
