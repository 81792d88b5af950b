"""What the entry module and the session do when something is absent."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tallyfold import session

HIDDEN = """
import sys, warnings
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "public_tokenizers":
            raise ImportError("no module named " + name)
sys.meta_path.insert(0, Hide())
warnings.simplefilter("ignore")
import __spark_entry__ as e
print("recap_union" in e.queries(), "pipeline" in e.queries())
"""


def test_core_queries_without_the_tokenizers():
    out = subprocess.run([sys.executable, "-c", HIDDEN], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr


@pytest.mark.parametrize("master,allowed", [("local", True), ("local[8]", True), ("local-cluster[3,2,1024]", False), ("spark://h:7077", False)])
def test_only_one_process_may_use_a_folder_of_its_machine(master, allowed, monkeypatch, tmp_path):
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            applicationId = f"test-{master}"

    Fake.sparkContext.master = master
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    if allowed:
        assert session.shared_folder(Fake) == str(tmp_path)
    else:
        with pytest.raises(RuntimeError):
            session.shared_folder(Fake)
