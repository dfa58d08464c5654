import subprocess
import sys
import textwrap

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and any(r["contaminated"] for r in rows)


def test_entry_imports_without_the_optional_part(tmp_path):
    code = textwrap.dedent(
        """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("judgelab.llm"):
                    raise ModuleNotFoundError(name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
        """
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
