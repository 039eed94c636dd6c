from .common import table
from .license_scan import scan_licenses
from .queries import query


@query
def op7_license_scan(spark, sf_dir):
    """License phrases and fuzzy notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
