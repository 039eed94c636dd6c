from pyspark.sql import functions as F

from .common import table
from .langid import fit, identify, in_fold
from .queries import query


@query
def op3_langid(spark, sf_dir):
    """Language of every document, learnt from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~in_fold(F.col("doc_id"))))
    return identify(docs, model).withColumn("held_out", in_fold(F.col("doc_id")))
