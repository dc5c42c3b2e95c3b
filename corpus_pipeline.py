"""The corpus pipeline: rules, near-duplicates, decontamination, mixing, training order."""

from newslens.llm.decontamination import remove_leaks
from newslens.llm.mixing import mix_documents
from newslens.llm.quality_rules import keep_good
from newslens.llm.simhash import keep_one
from newslens.llm.tables import keep, read_table
from newslens.llm.training_order import through_shards

# Small sources are drawn at most twice as often as the largest, which is drawn once in full.
MAX_REPEAT = 2.0


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the fixed and the adaptive rules."""
    return keep_good(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document, that with the smallest id, of each group of near-duplicates."""
    return keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Documents as often as their source's weight draws them, each at least once."""
    return mix_documents(docs, max_repeat=MAX_REPEAT)


def token_output(spark, docs, sf_dir):
    """Token sequences with their global slots, written as shard files and read back in slot order."""
    return through_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

# Fingerprints and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over `documents`; each one's rows are written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
