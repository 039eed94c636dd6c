from .common import table
from .queries import query
from .simhash import near_duplicates


@query
def op8_simhash(spark, sf_dir):
    """SimHash components over all documents, by meet-in-the-middle ball hashing."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")
