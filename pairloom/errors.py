"""Typed errors: an English text, an Arabic one, and what could help."""

from __future__ import annotations


class PairloomError(Exception):
    def __init__(self, message_en: str, message_ar: str = "", suggestion: str = "") -> None:
        super().__init__(message_en)
        self.message_en, self.message_ar, self.suggestion = message_en, message_ar or message_en, suggestion

    def bilingual(self) -> str:
        return f"{self.message_en} | {self.message_ar}" + (f" ({self.suggestion})" if self.suggestion else "")


class HardwareDetectionError(PairloomError): ...


class ConfigError(PairloomError): ...


class ImageReadError(PairloomError): ...


class ImageWriteError(PairloomError): ...


class MetadataError(PairloomError): ...


class SensorProfileError(PairloomError): ...


class DependencyMissingError(PairloomError):
    def __init__(self, package: str, feature: str) -> None:
        super().__init__(f"{feature} needs the package {package}", f"{feature}: الحزمة {package} غير متوفرة", f"install {package}")
        self.package, self.feature = package, feature


class FormatNotSupportedError(PairloomError):
    def __init__(self, path: str) -> None:
        super().__init__(f"no reader for {path}", f"لا يوجد قارئ للملف {path}")
        self.path = path


class PreprocessingError(PairloomError): ...


class QualityGateError(PreprocessingError): ...


class CoregistrationError(PreprocessingError): ...


class RadiometricError(PreprocessingError): ...


class MaskingError(PreprocessingError): ...


class SARCalibrationError(PreprocessingError): ...


class PipelineError(PreprocessingError): ...
