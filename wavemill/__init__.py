"""wavemill: a PySpark engine for curating, packing and scoring audio-and-text corpora."""
