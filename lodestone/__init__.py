"""A document analytics engine on Spark: a compact SQL-like dialect over nested documents, compiled to DataFrames."""
