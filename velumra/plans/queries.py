"""The registered queries of the graph, vector, text and tensor operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.numbers import rounded
from ..operators import centrality as scores
from ..operators import graph, knn, neural, paths, tensor, text
from ..sources import snapshot
from ..streaming.accumulate import EdgeFold, fold_stream
from . import graphs
from .lineage import fresh
from .sql import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.read(spark, sf_dir, "embeddings")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.read(spark, sf_dir, "documents").select("doc_id", "text")


def _next_to(spark: SparkSession, sf_dir: str, name: str, f) -> DataFrame:
    """Each vector and the one whose vec_id follows."""
    e = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", f(F.col("embedding"), F.col("other")).alias(name)).withColumn(name, rounded(name))


@query
def vec_dot(spark, sf_dir):
    return _next_to(spark, sf_dir, "dot", vectors.dot)


@query
def vec_l2(spark, sf_dir):
    return _next_to(spark, sf_dir, "distance", vectors.l2_distance)


@query
def vec_cosine(spark, sf_dir):
    return _next_to(spark, sf_dir, "cosine", vectors.cosine)


@query
def vec_normalize(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.transform(vectors.normalize(F.col("embedding")), rounded).alias("unit"))


@query
def sha256_digest(spark, sf_dir):
    docs = graphs.read(spark, sf_dir, "documents")
    return docs.select("doc_id", vectors.sha256_hex(F.col("text")).alias("one"), vectors.sha256_hex(F.col("text"), F.col("lang"), F.col("source")).alias("three"))


@query
def knn_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50, against all."""
    e = _embeddings(spark, sf_dir)
    return knn.nearest(e, e.where("vec_id % 50 = 0"), 10)


@query
def tokenize_counts(spark, sf_dir):
    return text.term_counts(_documents(spark, sf_dir))


@query
def vocab_first_seen(spark, sf_dir):
    return text.vocabulary(_documents(spark, sf_dir))


@query
def idf_weights(spark, sf_dir):
    return text.idf(_documents(spark, sf_dir)).withColumn("idf", rounded("idf"))


@query
def tfidf(spark, sf_dir):
    return text.tfidf(_documents(spark, sf_dir)).withColumn("weight", rounded("weight"))


@query
def tfidf_top_words(spark, sf_dir):
    return text.top_words(_documents(spark, sf_dir), 5)


@query
def encode_counts(spark, sf_dir):
    return text.encode_by_own(_documents(spark, sf_dir))


@query
def doc_cosine(spark, sf_dir):
    """Every document whose id is divisible by 50, against all."""
    return text.similar_documents(_documents(spark, sf_dir), 0.8, F.col("doc_id") % 50 == 0)


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", rounded("weight").alias("weight"), "last_modified", F.col("type").cast("int").alias("type"))


@query
def graph_upsert_nodes(spark, sf_dir):
    letter = F.when(F.col("o_orderkey") % 2 == 0, F.lit("C")).otherwise(F.lit("c"))
    orders = graphs.read(spark, sf_dir, "orders")
    log = orders.select(F.concat(letter, F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("id"), F.col("o_orderpriority").alias("data"), F.col("o_orderkey").alias("seq"))
    return graph.upsert_nodes(log)


@query
def graph_accumulate(spark, sf_dir):
    return _edges(graph.accumulate(graphs.supply_log(spark, sf_dir)))


@query
def graph_accumulate_events(spark, sf_dir):
    log = graphs.event_log(spark, sf_dir)
    nodes = log.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    return _edges(graph.accumulate(log, nodes))


@query
def stream_accumulate(spark, sf_dir):
    """The events, read as a stream."""
    schema = graphs.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = stream.select(
        graphs.named("U", F.col("user_id")).alias("from"), F.concat(F.lit("T"), F.col("event_type")).alias("to"), F.col("value").alias("delta"),
        F.col("ts").cast("timestamp").cast("long").alias("ts"), F.lit(graph.ASSOCIATIVE).alias("type"),
    )
    fold = EdgeFold(spark, fresh(spark, "folded"))
    fold_stream(log, fold, fresh(spark, "stream")).awaitTermination()
    return _edges(fold.edges)


@query
def graph_add_edges(spark, sf_dir):
    return _edges(graph.add_edges(graphs.hierarchy_log(spark, sf_dir).withColumnRenamed("delta", "weight")))


@query
def graph_merge(spark, sf_dir):
    edges = graph.accumulate(graphs.event_log(spark, sf_dir))
    return _edges(graph.merge(edges, edges))


@query
def graph_remove_nodes(spark, sf_dir):
    edges = graphs.hierarchy(spark, sf_dir)
    nation = graphs.read(spark, sf_dir, "nation").where("n_regionkey = 1")
    return _edges(graph.remove_nodes(graphs.ends(edges), edges, nation.select(graphs.named("N", F.col("n_nationkey")).alias("id")))[1])


@query
def graph_lookup(spark, sf_dir):
    """All customers, in either case, among those who ordered."""
    orders, customers = (graphs.read(spark, sf_dir, t) for t in ("orders", "customer"))
    nodes = graph.upsert_nodes(orders.select(graphs.named("c", F.col("o_custkey")).alias("id"), F.lit(None).cast("string").alias("data"), F.col("o_orderkey").alias("seq")))
    letter = F.when(F.col("c_custkey") % 2 == 0, F.lit("C")).otherwise(F.lit("c"))
    return graph.lookup(nodes, customers.select(F.concat(letter, F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("id")))


@query
def graph_neighbours(spark, sf_dir):
    return _edges(graph.neighbours(graphs.hierarchy(spark, sf_dir), "N0000007"))


@query
def graph_node_project(spark, sf_dir):
    nodes = graph.index_log(graphs.mixed_log(spark, sf_dir))
    return graph.project(nodes, F.col("id"), F.upper(F.substring("id", 1, 1)).alias("kind"), F.length("id").alias("width"))


@query
def graph_decay_edges(spark, sf_dir):
    edges = graph.accumulate(graphs.event_log(spark, sf_dir))
    now = edges.agg(F.max("last_modified")).first()[0] or 0
    return _edges(graph.decay_edges(edges, 0.05, now))


def _mixed(spark: SparkSession, sf_dir: str) -> graph.Compiled:
    return graph.compile_log(graphs.mixed_log(spark, sf_dir))


def _supply(spark: SparkSession, sf_dir: str) -> graph.Compiled:
    return graph.compile_log(graphs.supply_log(spark, sf_dir))


def _hierarchy(spark: SparkSession, sf_dir: str) -> graph.Compiled:
    return graph.compile_log(graphs.hierarchy_log(spark, sf_dir))


def _indexed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("type", F.col("type").cast("int"))


@query
def graph_compile_nodes(spark, sf_dir):
    return graph.index_log(graphs.mixed_log(spark, sf_dir))


@query
def graph_compile_edges(spark, sf_dir):
    return _indexed(_mixed(spark, sf_dir).edges)


@query
def graph_row_ptr(spark, sf_dir):
    return _mixed(spark, sf_dir).row_ptr()


@query
def graph_slice(spark, sf_dir):
    return _indexed(_mixed(spark, sf_dir).slice(~F.col("id").startswith("c")).edges)


@query
def graph_boundary(spark, sf_dir):
    compiled = _mixed(spark, sf_dir)
    return compiled.boundary(compiled.node_index.where(F.col("id").startswith("s")))


@query
def graph_weights(spark, sf_dir):
    return _mixed(spark, sf_dir).weights()


@query
def graph_jaccard(spark, sf_dir):
    """Of suppliers, by the parts that they deliver."""
    compiled = _supply(spark, sf_dir).written()
    suppliers = compiled.node_index.where(F.col("id").startswith("s")).select(F.col("idx").alias("src_idx"))
    return graph.jaccard(compiled.edges.join(suppliers, "src_idx", "left_semi")).withColumn("similarity", rounded("similarity"))


@query
def components_weak(spark, sf_dir):
    return paths.components(_supply(spark, sf_dir))


@query
def components_weak_threshold(spark, sf_dir):
    return paths.components(_supply(spark, sf_dir), F.col("weight") > 120)


@query
def components_directed(spark, sf_dir):
    return paths.directed_components(_hierarchy(spark, sf_dir))


def _regions(compiled: graph.Compiled) -> DataFrame:
    return compiled.node_index.where(F.col("id").startswith("r"))


@query
def dependency_depth(spark, sf_dir):
    compiled = _mixed(spark, sf_dir)
    return paths.dependency_depth(compiled, _regions(compiled), 3)


@query
def dependency_depth_structural(spark, sf_dir):
    compiled = _mixed(spark, sf_dir)
    return paths.dependency_depth(compiled, _regions(compiled), -1)


@query
def flow_rank(spark, sf_dir):
    return paths.flow_rank(_hierarchy(spark, sf_dir))


@query
def cycle_check(spark, sf_dir):
    """The hierarchy with one region's nations pointing back at it."""
    edges = graphs.hierarchy(spark, sf_dir).select(F.col("src").alias("src_idx"), F.col("dst").alias("dst_idx"))
    back = graphs.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(graphs.named("n", F.col("n_nationkey")).alias("src_idx"), graphs.named("r", F.col("n_regionkey")).alias("dst_idx"))
    return paths.cyclic_edges(edges.unionByName(back)).select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"))


@query
def centrality_k5(spark, sf_dir):
    return scores.centrality(_supply(spark, sf_dir), 5, 0.0).withColumn("centrality", rounded("centrality"))


@query
def centrality_full(spark, sf_dir):
    return scores.centrality(_supply(spark, sf_dir))


@query
def topology_hash(spark, sf_dir):
    return spark.createDataFrame([(_mixed(spark, sf_dir).topology_hash().hex().upper(),)], "digest string")


@query
def snapshot_roundtrip(spark, sf_dir):
    path = fresh(spark, "snapshot")
    snapshot.save(_mixed(spark, sf_dir), path)
    return _indexed(snapshot.load(spark, path).edges)


def _cells(spark: SparkSession, sf_dir: str) -> tensor.Matrix:
    e = _embeddings(spark, sf_dir)
    cells = e.select(F.col("vec_id").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    return tensor.Matrix(e.count(), 64, cells.select("i", F.col("j").cast("long").alias("j"), "v"))


def _weight(spark: SparkSession) -> tensor.Matrix:
    return tensor.Matrix(64, 64, tensor.zeros(spark, 64, 64).cells.select("i", "j", F.sin(F.col("i") * 31.0 + F.col("j")).alias("v")))


def _bias(spark: SparkSession) -> tensor.Matrix:
    return tensor.Matrix(1, 64, tensor.zeros(spark, 1, 64).cells.select("i", "j", F.cos(F.col("j").cast("double")).alias("v")))


def _rounded(m: tensor.Matrix) -> DataFrame:
    return m.cells.withColumn("v", rounded("v"))


@query
def transpose(spark, sf_dir):
    return _cells(spark, sf_dir).transpose().cells


@query
def matmul(spark, sf_dir):
    x = _cells(spark, sf_dir)
    return _rounded(x.transpose().matmul(x))


@query
def matmul_grad(spark, sf_dir):
    """Of x times a weight, where the result's gradient is x again."""
    x = _cells(spark, sf_dir)
    a, b = tensor.matmul_gradients(x, _weight(spark), x)
    return _rounded(a).select(F.lit("a").alias("operand"), "i", "j", "v").unionByName(_rounded(b).select(F.lit("b").alias("operand"), "i", "j", "v"))


@query
def add_broadcast(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir) + _bias(spark))


@query
def add_broadcast_grad(spark, sf_dir):
    return _rounded(tensor.add_gradient(_bias(spark), _cells(spark, sf_dir)))


@query
def relu(spark, sf_dir):
    return _cells(spark, sf_dir).relu().cells


@query
def relu_grad(spark, sf_dir):
    x = _cells(spark, sf_dir)
    return tensor.relu_gradient(x, x).cells


@query
def tanh(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir).tanh())


@query
def tanh_grad(spark, sf_dir):
    x = _cells(spark, sf_dir)
    return _rounded(tensor.tanh_gradient(x, x))


@query
def tensor_decay(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir).decay(0.005, 138.629))


@query
def linear_forward(spark, sf_dir):
    return _rounded(tensor.linear(_cells(spark, sf_dir), _weight(spark), _bias(spark)))


@query
def sgd_step(spark, sf_dir):
    x = _cells(spark, sf_dir)
    return _rounded(tensor.sgd_step(_weight(spark), tensor.matmul_gradients(x, _weight(spark), x)[1], 0.01))


@query
def zeros(spark, sf_dir):
    return tensor.zeros(spark, 100, 64).cells


@query
def random_normal(spark, sf_dir):
    return _rounded(tensor.gaussian(spark, 100, 64, 42))


@query
def mlp_train(spark, sf_dir):
    """Mean loss of a network that learns each embedding's first value from all."""
    e = _embeddings(spark, sf_dir).where("embedding IS NOT NULL")
    rows = e.select(F.col("embedding").cast("array<double>").alias("x"), F.array(F.col("embedding")[0].cast("double")).alias("y"))
    model = neural.Sequential(neural.Linear(64, 16, 1), neural.Tanh(), neural.Linear(16, 1, 2))
    losses = neural.train(rows, model, 0.1, 5)
    return spark.createDataFrame([(k, x) for k, x in enumerate(losses)], T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("loss", T.DoubleType())]))
