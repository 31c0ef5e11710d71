import subprocess
import sys

from pyspark import cloudpickle

from dateline.operators.markup import read_tree


def test_task_code_needs_no_copy_of_the_package(tmp_path):
    """Executors without the package still run its functions."""
    (tmp_path / "f.pickle").write_bytes(cloudpickle.dumps(read_tree))
    code = "import pickle; print(pickle.load(open('f.pickle', 'rb'))('<p>a<p>b').tag)"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={}
    )
    assert done.stdout.strip() == "['p', 'p']"
