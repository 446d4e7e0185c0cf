"""Record types as DDL, and the one list of classes that all operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class keys by id.
CLASSES = ("nasi_lemak", "roti_canai", "char_kuey_teow", "chicken_rice", "laksa", "mee_goreng")


DOWNLOAD = "image_id string, candidate_class string, query string, source_url string, source_domain string, engine string, local_path string, downloaded_at timestamp, sha256 string, file_bytes long, width int, height int, decode_error string"
CURATION = (
    "image_id string, source_path string, candidate_class string, sha256 string, file_bytes long, width int, height int, dhash string, blur_variance double, status string, reasons array<string>, duplicate_of string, "
    "semantic_scores map<string,double>, predicted_class string, intended_score double, score_margin double, calibration_score double, calibration_threshold double"
)
MANUAL_DECISION = "candidate_class string, sha256 string, image_id string, source_path string, label string"
CALIBRATION_CLASS = "class_name string, positive_centroid array<double>, negative_centroid array<double>, threshold double, validation_precision double, validation_recall double, validation_coverage double, accepted_validation_count int, positive_count int, negative_count int"
SOURCE = "struct<dataset:string,image:string,label:string,split:string>"
MANIFEST = (
    f"annotation_conflict boolean, annotation_status string, bbox_count int, class_id int, class_name string, destination_image string, destination_label string, dhash string, leakage_group string, sha256 string, sources array<{SOURCE}>, "
    "ingest_id string, cvat_job_id long, cvat_task_id long, reviewed_at string, rejection_reason string, original_class_id int, original_class_name string, annotation_source string, audit_revision_id string"
)
SPLIT_MANIFEST = "bbox_count int, class_id int, class_name string, destination_image string, destination_label string, label_sha256 string, leakage_group string, object_class_counts map<string,int>, sha256 string, source_image string, source_label string, split string, assignment_source string"
BOX_FIELDS = "class_id:int,class_name:string,confidence:double,height:double,width:double,x_center:double,y_center:double"
PREDICTION = f"boxes array<struct<{BOX_FIELDS}>>, image_filename string, leakage_group string, predicted_classes array<string>, review_priority string, review_reasons array<string>, sha256 string, source_class string"
NUTRITION = "class_name string, display_name string, calories_kcal double, protein_g double, carbs_g double, fat_g double, sodium_mg double, allergens array<string>, dietary_tags array<string>, health_notes string, found_in_kb boolean"
CSV_BOX = "filename string, width int, height int, class string, xmin double, ymin double, xmax double, ymax double"


def class_dim(spark: SparkSession, names: tuple[str, ...] = CLASSES) -> DataFrame:
    """(class_id, class_name), one row per class."""
    return spark.createDataFrame([*enumerate(names)], "class_id int, class_name string")
