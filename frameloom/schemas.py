"""Explicit schemas of the tables; nothing is inferred."""

VIDEOS = "video_id string, uri string, display_name string, duration_ms long, width int, height int, rotation int, frame_count int"
FRAMES = "video_id string, frame_idx int, ts_ms long, w int, h int, gray array<int>"
DETECTIONS = (
    "video_id string, frame_idx int, ts_ms long, frame_sharp double, det_idx int, left int, top int, right int, bottom int, "
    "euler_y float, euler_z float, left_eye float, right_eye float, smiling float, tracking_id int, "
    "eye_lx float, eye_ly float, eye_rx float, eye_ry float, nose_x float, nose_y float, mouth_x float, mouth_y float, "
    "face_sharp double, frame_w int, frame_h int"
)
FACE_SAMPLES = (
    "video_id string, seq int, frame_idx int, ts_ms long, embedding array<float>, sharpness double, euler_y float, euler_z float, "
    "eye_open float, smiling float, edge_clipped boolean, area int, tracking_id int, left int, top int, right int, bottom int, "
    "frame_w int, frame_h int, solo_frame boolean"
)
CLUSTERS = "video_id string, cluster_id int, member_pos int, seq int"
APPEARANCES = "video_id string, person_id int, start_ms long, end_ms long, frames int"
DECISIONS = "video_id string, n int, msg string"
