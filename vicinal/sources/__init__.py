"""Readers and writers of vector files."""

from vicinal.sources.knnbin import KnnBinDataSource, read_knnbin, register, write_knnbin
from vicinal.sources.text import convert_to_knnbin, read_arff, read_libsvm, read_vector_csv, write_arff, write_libsvm, write_vector_csv

__all__ = ["KnnBinDataSource", "convert_to_knnbin", "read_arff", "read_knnbin", "read_libsvm", "read_vector_csv", "register", "write_arff", "write_knnbin", "write_libsvm", "write_vector_csv"]
