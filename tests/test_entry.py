import __spark_entry__ as entry


def test_queries_and_sql_have_the_same_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40


def test_rest_stands_without_text_operators():
    """The package imports without its text operators."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    code = textwrap.dedent("""
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("wayfray.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert len(e.queries()) > 40 and not any(k.startswith("op") for k in e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True)
