"""What Spark moved while a block ran."""

from contextlib import contextmanager


@contextmanager
def moved(spark):
    """Bytes shuffled and written by the stages that ran inside, as the item `bytes`."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() + stages.apply(k).outputBytes() for k in range(stages.size()))

    out, before = {}, total()
    yield out
    out["bytes"] = total() - before
