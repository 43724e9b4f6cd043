"""The driver contract with and without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CALL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(TOP, "")}
    out = subprocess.run([sys.executable, "-B", "-c", CALL], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return tuple(map(int, out.stdout.split()[-2:]))


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder", "broken import"])
def test_queries_without_corpus_operators(tmp_path, left):
    top = tmp_path / "repo"
    shutil.copytree(TOP, top, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if left == "pipeline" else ["corpus_pipeline.py"])))
    if left == "empty folder":
        (top / "panelmill/llm").mkdir()
    if left == "broken import":
        (top / "panelmill/llm").mkdir()
        (top / "panelmill/llm/__init__.py").write_text("")
        (top / "panelmill/llm/queries.py").write_text("import a_module_that_is_not_installed\n")
    count, corpus = names(top)
    assert count > 200 and corpus == 0


def test_tasks_of_the_trades_grow_with_the_table(spark, monkeypatch):
    """Bars are made and sorted by as many tasks as the table needs, however few a shuffle has; beside the scan no table of bars is held."""
    from panelmill.sources import market

    root = "/root/testdata/sf0.001"
    bars = [sorted(market.Market(spark, root).panel.select("sec_id", "m", "n_days", "price", "ret_next").collect())]
    monkeypatch.setattr(market, "TRADES", 500)
    t = market.Market(spark, root)
    assert t.tasks == -(-t.table("lineitem").count() // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = t.panel._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line and f", {t.tasks})" in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)
    assert "partial_" not in plan[plan.index(dealt[1]) :]
    bars.append(sorted(t.panel.select("sec_id", "m", "n_days", "price", "ret_next").collect()))
    assert [r[:3] for r in bars[0]] == [r[:3] for r in bars[1]]
    assert all(abs((a or 0) - (b or 0)) < 1e-9 for one, two in zip(*bars) for a, b in zip(one[3:], two[3:]))
