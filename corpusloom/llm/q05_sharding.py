from .common import table
from .queries import query
from .sharding import shard


@query
def op5_sharding(spark, sf_dir):
    """All documents in 40 shards of near equal bytes, through virtual slots."""
    return shard(table(spark, sf_dir, "documents"))
