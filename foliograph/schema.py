"""The document graph as two tables.

nodes: doc_id, artifact_id (the scope: a slide, a sheet, or a whole text document), ordinal (document order), id, type,
name, text and, where there is a layout, page_index and a bbox of 0-1000 units.
edges: doc_id, edge_ord, type, source_id, target_id and what made them. A null column means that the property is absent.
"""

from pyspark.sql import types as T

NODE_TYPES = ("File", "Artifact", "Text", "Table", "Image", "Group")
EDGE_TYPES = ("PARENT_OF", "NEXT", "CAPTION_OF", "REFERENCES")
CONTAINERS = ("File", "Artifact")

BBOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x_min", "y_min", "x_max", "y_max")])
NODE = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("artifact_id", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("bbox", BBOX),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("outline_level", T.IntegerType()),
        T.StructField("is_toc", T.BooleanType()),
        T.StructField("list_num_id", T.IntegerType()),
        T.StructField("list_level", T.IntegerType()),
        T.StructField("image_path", T.StringType()),
    ]
)
EDGE = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("edge_ord", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("type", "source_id", "target_id", "structural_source")]
)
