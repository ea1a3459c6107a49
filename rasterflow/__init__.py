"""Relational image coding and corpus processing on Spark.

``convert_file`` and ``convert_folder`` turn PPM files into JPEG files; the rest is in the subpackages.
"""


def __getattr__(name: str):
    if name in ("convert_file", "convert_folder"):
        from rasterflow.plans import convert

        return getattr(convert, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
