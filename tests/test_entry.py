import subprocess
import sys
import zipfile

import __spark_entry__


def test_the_package_can_be_sent(tmp_path):
    """The archive alone is enough to import the operators."""
    path = __spark_entry__.package_file()
    assert "sensorloom/plans/catalog.py" in zipfile.ZipFile(path).namelist()
    code = "from sensorloom.operators import blocks, quantiles; from sensorloom.plans import catalog; print(len(catalog.queries()), blocks.__file__)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": path, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert "sensorloom.zip" in said.stdout, said.stderr
