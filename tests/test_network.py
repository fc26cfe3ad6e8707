import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from agrolith.operators.network import TwoLayer, network_pass


def _data(spark, n=300):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    rows = [(list(map(float, a)), int(b)) for a, b in zip(x, y)] + [(None, 1), ([1.0], 0), ([1.0, None, 0.0, 0.0], 1), ([0.0] * 4, None), ([0.0] * 4, 9)]
    return spark.createDataFrame(rows, "v array<double>, label int"), x, y


def _net(seed=1):
    rng = np.random.default_rng(seed)
    return TwoLayer(rng.normal(size=(4, 5)), rng.normal(size=5), rng.normal(size=(5, 3)), rng.normal(size=3))


def test_gradients_equal_differences_of_the_loss(spark):
    df, x, y = _data(spark)
    net = _net()
    got = network_pass(df.repartition(3), "v", "label", net)
    loss = lambda: float(-net.forward(x)[1][np.arange(len(y)), y].mean())
    assert got["rows"] == 300 and abs(got["loss"] - loss()) < 1e-12
    for name in ("w1", "b1", "w2", "b2"):
        w = getattr(net, name)
        for at in ([(0,) * w.ndim, tuple(s - 1 for s in w.shape)]):
            keep, ends = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = keep + step
                ends.append(loss())
            w[at] = keep
            assert abs((ends[0] - ends[1]) / 2e-6 - got[name][at]) < 1e-6
    assert network_pass(df.limit(0), "v", "label", net)["rows"] == 0


def test_trained_weights_have_a_smaller_loss_and_gradient(spark):
    df, x, y = _data(spark)
    good = df.where("size(v) = 4 and label between 0 and 2 and not exists(v, e -> e is null)").withColumn("features", array_to_vector(F.col("v")))
    model = MultilayerPerceptronClassifier(layers=[4, 5, 3], maxIter=200, seed=1).fit(good)
    w = model.weights.toArray()
    net = TwoLayer(w[:20].reshape(4, 5), w[20:25], w[25:40].reshape(5, 3), w[40:43])
    got, start = network_pass(df, "v", "label", net), network_pass(df, "v", "label", _net())
    assert abs(got["accuracy"] - model.summary().accuracy) < 1e-12
    assert got["loss"] < start["loss"] and np.abs(got["w1"]).max() < np.abs(start["w1"]).max()
