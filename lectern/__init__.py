"""Analytics over archives of transcripts and long texts, as PySpark DataFrame plans."""
