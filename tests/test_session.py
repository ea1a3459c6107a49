import subprocess
import sys
from types import SimpleNamespace

from rasterflow import session


def fake(master):
    sent = []
    context = SimpleNamespace(master=master, environment={}, addPyFile=sent.append)
    return SimpleNamespace(conf=SimpleNamespace(set=lambda *_: None), sparkContext=context), sent


def test_a_cluster_gets_the_package():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"):
        spark, sent = fake(master)
        session.ship(spark)
        session.ship(spark)
        assert len(sent) == 1 and not spark.sparkContext.environment
    # a worker without the source finds all modules in the archive
    code = "import sys; sys.path.insert(0, sys.argv[1]); import rasterflow.plans.fused as m; assert 'rasterflow.zip' in m.__file__, m.__file__"
    subprocess.run([sys.executable, "-c", code, sent[0]], cwd="/", check=True, timeout=120)


def test_one_machine_reads_the_folder():
    for master in ("local", "local[4]", "local[*]"):
        spark, sent = fake(master)
        session.ship(spark)
        assert not sent and str(session.ROOT) in spark.sparkContext.environment["PYTHONPATH"]
