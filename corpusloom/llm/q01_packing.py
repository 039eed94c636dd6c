from .common import table
from .packing import pack
from .queries import query, tokenizer


@query
def op1_packing(spark, sf_dir):
    """Deficit round-robin packing of all documents at each source's share of the tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)
