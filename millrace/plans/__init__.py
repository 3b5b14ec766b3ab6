

from . import catalog, exchange  # noqa: F401 (exchange registers its queries in the catalog)
