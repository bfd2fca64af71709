"""Power-line corridor analytics on Spark DataFrames."""

from sagline.schema import Params

__all__ = ["Params"]
