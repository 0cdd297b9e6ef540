"""Archives, recorder (SUD) files and PCM WAV files as Spark sources and sinks."""
