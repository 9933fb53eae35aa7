import subprocess
import sys

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_data_folder():
    code = "import sys; sys.modules['vitrine.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True)


def test_other_missing_modules_are_errors():
    code = "import sys; sys.modules['zstandard'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    assert e.name == 'zstandard'\nelse:\n    assert not __import__('importlib').util.find_spec('vitrine.llm')"
    subprocess.run([sys.executable, "-c", code], check=True)
