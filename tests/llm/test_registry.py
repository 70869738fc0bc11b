import inspect

import __spark_entry__ as entry
import corpus_pipeline
from threadlens.llm import registry


def test_every_operator_is_registered():
    names = set(entry.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(registry.ORACLE) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


def test_native_operators_have_no_python_in_tasks():
    from threadlens.llm import licenses, pseudonyms, secrets, spans

    for module in (licenses, pseudonyms, secrets, spans):
        source = inspect.getsource(module)
        assert not any(x in source for x in ("udf", "mapIn", "applyIn", ".rdd", "pandas"))
