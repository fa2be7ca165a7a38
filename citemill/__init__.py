"""citemill: author disambiguation and publication counting as PySpark dataflows."""
