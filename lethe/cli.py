"""Command line: mask the Word packages of a folder.  spark-submit lethe/cli.py IN OUT [--rules FOLDER]

Exit status: 0 all were masked, 1 a package was refused or blocked, 2 the arguments or rules cannot be used, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import audit, resolve
from lethe.operators.detect import detect, split_review
from lethe.operators.screen import screen
from lethe.sources import rules, word


def mask_packages(packages: DataFrame, given: rules.RuleSet, limits: word.Limits = word.Limits()) -> tuple[DataFrame, DataFrame]:
    """(document_id, content, code, status) of every package, masked where the audit lets it pass, and the findings."""
    seen = word.inspect(packages, limits)
    plain = word.normalize(packages, limits)
    units = word.text_units(plain, limits)
    joined = units.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    refused = screen(joined, rules=given.screening).filter("refused_by IS NOT NULL").select("document_id")
    keys = ["document_id", "unit_id"]
    spans, _ = split_review(detect(units.join(refused, "document_id", "left_anti").select(*keys, "unit_type", "header", "text"), given.detectors))
    plan = resolve.resolve(spans, keys, policy=given.policy)
    done = word.write_redacted(plain.join(refused, "document_id", "left_anti"), plan, limits)
    after = word.text_units(done.select("document_id", "content"), limits)
    findings = audit.scan(after.select("document_id", "unit_ord", "text"), "text", "document_id", "unit_ord").select("document_id", "kind", "severity", "category")
    found = findings.unionByName(audit.remediable(word.package_findings(done.select("document_id", "content"), limits)).select("document_id", "kind", "severity", "category"))
    stop = audit.blocking(found).select("document_id").distinct().withColumn("stop", F.lit(True))
    out = seen.join(refused.withColumn("asks", F.lit(True)), "document_id", "left").join(done.select("document_id", "content"), "document_id", "left").join(stop, "document_id", "left")
    code = F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("asks"), "PROMPT_INJECTION").when(F.col("stop"), "BLOCKED_BY_AUDIT")
    return out.select("document_id", F.when(code.isNull(), F.col("content")).alias("content"), code.alias("code"), F.when(F.col("code").isNotNull(), F.col("status")).when(code.isNotNull(), 422).alias("status")), found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--rules")
    args = parser.parse_args(argv)
    try:
        given = rules.load(args.rules) if args.rules else rules.RuleSet()
    except rules.ConfigurationError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        done, _ = mask_packages(word.load(spark, args.source), given)
        word.save(done.select("document_id", "content"), args.target).count()
        codes = {r["code"] or "MASKED": r["count"] for r in done.groupBy("code").count().collect()}
    except KeyboardInterrupt:
        return 130
    print(json.dumps(codes, sort_keys=True))
    return int(any(k != "MASKED" for k in codes))


if __name__ == "__main__":
    sys.exit(main())
