import re


def _run(spark, capsys, monkeypatch, *args):
    import tillroll.__main__ as cli
    import tillroll.session as session

    monkeypatch.setattr(session, "local_session", lambda *a, **k: spark)
    monkeypatch.setattr(spark, "stop", lambda: None)
    cli.main([*args, "--sf", "/root/testdata/sf0.001"])
    return capsys.readouterr().out


def test_cli_prints_every_frame_of_a_page(spark, capsys, monkeypatch):
    out = _run(spark, capsys, monkeypatch, "brands", "--min-transactions", "0")
    for name in ("category_count", "categories_head", "performance", "drop", "kpis", "table"):
        assert f"== {name}" in out


def test_cli_prints_the_top_list_descending(spark, capsys, monkeypatch):
    out = _run(spark, capsys, monkeypatch, "top_products")
    top = out.split("== top\n")[1].split("==")[0].strip().splitlines()
    revenue = [float(re.findall(r"\d+\.\d+", line)[0]) for line in top[1:]]
    assert len(revenue) == 5 and revenue == sorted(revenue, reverse=True)


def test_cli_process_starts_without_settings():
    """The command line itself, with nothing replaced and no checkpoint folder set."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "tillroll", "home", "--sf", "/root/testdata/sf0.001"], cwd=root, capture_output=True, text=True, timeout=180)
    assert "== kpis" in out.stdout, out.stderr[-500:]
