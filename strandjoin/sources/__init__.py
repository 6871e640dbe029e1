"""FASTQ sources and sinks."""
