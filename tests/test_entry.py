import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "html_to_markdown" in entry.queries()


def test_without_the_llm_folders(tmp_path):
    """The rest imports alone, as it does after both folders and the pipeline are deleted."""
    for p in ("__spark_entry__.py", "inkmill"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "inkmill").mkdir()
    for p in (ROOT / "inkmill").iterdir():
        if p.name != "llm":
            (tmp_path / "inkmill" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'html_to_markdown' in q, q"
    entry = tmp_path / "__spark_entry__.py"
    entry.unlink()
    entry.write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_errors_inside_the_llm_folder_are_not_hidden(tmp_path):
    (tmp_path / "inkmill" / "llm").mkdir(parents=True)
    for p in (ROOT / "inkmill").iterdir():
        if p.name != "llm":
            (tmp_path / "inkmill" / p.name).symlink_to(p)
    (tmp_path / "inkmill" / "llm" / "__init__.py").write_text("")
    (tmp_path / "inkmill" / "llm" / "queries.py").write_text("import no_such_module\n")
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode and "no_such_module" in done.stderr
