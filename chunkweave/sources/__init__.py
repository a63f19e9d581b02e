"""Parsers: from files, folders, archives, reference documents and stores to groups of virtual arrays."""

from .base import FileParser, Parsed, ParsedFile
from .dmrpp import DMRPPParser
from .fits import FITSParser
from .hdf import HDFParser
from .kerchunk import KerchunkJSONParser, KerchunkParquetParser
from .netcdf3 import NetCDF3Parser
from .store import StoreParser
from .zarr import ZarrParser, ZippedZarrParser

__all__ = ["DMRPPParser", "FITSParser", "FileParser", "HDFParser", "KerchunkJSONParser", "KerchunkParquetParser", "NetCDF3Parser", "Parsed", "ParsedFile", "StoreParser", "ZarrParser", "ZippedZarrParser"]
