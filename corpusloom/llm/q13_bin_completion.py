from .bin_completion import fit
from .common import table
from .queries import query, tokenizer


@query
def op13_bin_completion(spark, sf_dir):
    """All documents in as few sequences as bin completion finds."""
    return fit(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)
