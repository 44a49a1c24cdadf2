"""Prompts as Columns: evidence numbered from one, each line naming where it comes from. The instructions are the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence and counter-evidence of a claim that a prompt shows.
SHOWN, COUNTERED = 3, 2


def _numbered(items: Column, line) -> Column:
    return F.array_join(F.transform(items, lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), line(x))), "\n")


def _text(value: Column, missing: str = "?") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def _place(x: Column) -> Column:
    return F.concat_ws("/", _text(x["source"], ""), _text(x["doc_id"], ""))


def analysis_prompt(instructions: Column, query: Column, blocks: Column) -> Column:
    """blocks: array of source, doc_id, page, text, numbered by their place."""
    lines = _numbered(blocks, lambda x: F.concat(F.lit("("), _place(x), F.lit(" page "), _text(x["page"]), F.lit(") "), _text(x["text"], "")))
    return F.concat(instructions, F.lit("\n\nQuestion: "), query, F.lit("\n\n"), lines)


def section_prompt(instructions: Column, query: Column, blocks: Column) -> Column:
    """blocks: array of n, source, doc_id, page, text, numbered through the whole document by n."""
    line = lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] ("), _place(x), F.lit(" page "), _text(x["page"]), F.lit(") "), _text(x["text"], ""))
    return F.concat(instructions, F.lit("\n\nQuestion: "), query, F.lit("\n\n"), F.array_join(F.transform(blocks, line), "\n"))


def summary_prompt(instructions: Column, entity: Column, reason: Column, evidence: Column) -> Column:
    """evidence: array of kind (claim, document_block or analysis) with claim_id, revision, status, source, doc_id, version_id, extraction_id, block_id, page, run_id, model_identity, text, and of a claim
    refs (source, doc_id, version_id) and counters (JSON texts), of which the first few are shown under it."""
    version = lambda x: F.concat_ws("/", _text(x["source"], ""), _text(x["doc_id"], ""), _text(x["version_id"], ""))
    under = lambda x: F.concat(
        F.array_join(F.transform(F.slice(F.coalesce(x["refs"], F.array().cast("array<struct<source:string,doc_id:string,version_id:string>>")), 1, SHOWN), lambda r: F.concat(F.lit("\n    evidence: "), version(r))), ""),
        F.array_join(F.transform(F.slice(F.coalesce(x["counters"], F.array().cast("array<string>")), 1, COUNTERED), lambda r: F.concat(F.lit("\n    counter: "), r)), ""),
    )
    claim = lambda x: F.concat(F.lit("(claim "), _text(x["claim_id"]), F.lit(" rev"), _text(x["revision"]), F.lit(", "), _text(x["status"]), F.lit(") "), _text(x["text"], ""), under(x))
    block = lambda x: F.concat(F.lit("(report "), version(x), F.lit(" extraction "), _text(x["extraction_id"]), F.lit(" block "), _text(x["block_id"]), F.lit(" page "), _text(x["page"]), F.lit(") "), _text(x["text"], ""))
    run = lambda x: F.concat(F.lit("(analysis "), version(x), F.lit(" run "), _text(x["run_id"]), F.lit(" model "), _text(x["model_identity"]), F.lit(") "), _text(x["text"], ""))
    lines = _numbered(evidence, lambda x: F.when(x["kind"] == "claim", claim(x)).when(x["kind"] == "document_block", block(x)).otherwise(run(x)))
    return F.concat(instructions, F.lit("\n\nEntity: "), entity, F.lit("\nUpdate reason: "), reason, F.lit("\n\n"), lines)
