"""The news queries are there whatever of the corpus operators can be imported."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["tiktoken", "xxhash", "newslens.llm", "corpus_pipeline"])
def test_news_queries_without_a_corpus_module(blocked):
    code = (
        f"import sys; sys.modules['{blocked}'] = None; import __spark_entry__ as c; "
        "own = {q.__name__ for q in c.QUERIES}; assert own <= set(c.queries()); "
        "assert own == set(c.oracle_sql()) - set(c.CORPUS_SQL); print(len(own))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 49
