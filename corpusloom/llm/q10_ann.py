from .ann import nearest
from .common import table
from .queries import query


@query
def op10_ann(spark, sf_dir):
    """20 nearest rows of every 20th vector, by multi-index hashing."""
    return nearest(table(spark, sf_dir, "embeddings"))
