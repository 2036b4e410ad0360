"""Assayloom: DataFrame operators for curating, labelling, splitting and scoring assay data."""
