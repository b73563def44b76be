"""Pixel types."""

from __future__ import annotations

import enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


# The type codes of raster files' common interchange library.
FILE_CODES = {"uint8": 1, "uint16": 2, "int16": 3, "uint32": 4, "int32": 5, "float32": 6, "float64": 7, "uint64": 12, "int64": 13, "int8": 14}


class DataType(enum.Enum):
    """Declared type of a layer's pixels.  Byte is another name of UInt8."""

    UInt8 = "uint8"
    Int8 = "int8"
    Int16 = "int16"
    UInt16 = "uint16"
    Int32 = "int32"
    UInt32 = "uint32"
    Int64 = "int64"
    UInt64 = "uint64"
    Float32 = "float32"
    Float64 = "float64"
    Byte = "uint8"  # noqa: PIE796

    @property
    def numpy(self) -> np.dtype:
        return np.dtype(self.value)

    @property
    def is_float(self) -> bool:
        return self.numpy.kind == "f"

    @property
    def sizeof(self) -> int:
        return self.numpy.itemsize

    @property
    def limits(self) -> tuple[float, float]:
        info = np.finfo(self.numpy) if self.is_float else np.iinfo(self.numpy)
        return info.min, info.max

    def to_gdal(self) -> int:
        return FILE_CODES[self.value]

    @classmethod
    def of_gdal(cls, code: int) -> DataType:
        for name, own in FILE_CODES.items():
            if own == code:
                return cls(name)
        raise ValueError(f"no pixel type has code {code}")

    @classmethod
    def of_array(cls, array: np.ndarray) -> DataType:
        """The type of an array's elements; ValueError for types that pixels can't have (bool, complex ...)."""
        return cls(np.asarray(array).dtype.name)

    @classmethod
    def of_literal(cls, value: object) -> DataType:
        kind = np.result_type(value)
        return cls.Int64 if kind.kind == "b" else cls(kind.name)

    @classmethod
    def joint(cls, types: list[DataType]) -> DataType:
        """The type that holds all of ``types`` by numpy's promotion."""
        return cls(np.result_type(*(t.numpy for t in types)).name)

    def spark(self) -> str:
        """Type of the value column: unsigned types are held by the next wider signed one."""
        return {"uint8": "smallint", "int8": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}[self.value]

    def converted(self, c: Column, from_float: bool) -> Column:
        """``c`` as this type: fractions are cut off, whole numbers wrap round, NaN and infinities become 0 in whole types."""
        if self.is_float:
            c = c.cast("double")
            return c.cast("float").cast("double") if self is DataType.Float32 else c
        if from_float:
            c = F.when(F.isnan(c) | (F.abs(c) >= 2.0**63), F.lit(0)).otherwise(c.try_cast("bigint"))
        bits = 8 * self.sizeof
        c = c.cast("bigint")
        if bits == 64:
            return c
        low = c.bitwiseAND(F.lit((1 << bits) - 1))
        return low if self.numpy.kind == "u" else F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low)
