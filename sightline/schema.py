"""Schemas of the stored entities. Stamps are nanoseconds as long; ids start at 1."""

from __future__ import annotations

# Fixed layouts, as DDL text.
DDL = {
    "index": "stamp_ns long, filename string",
    "frames": "frame_idx int, stamp_ns long, rgb string, depth string, seg string",
    "odom": "stamp_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double",
    "tf_static": "frame_id string, child_frame_id string, tx double, ty double, tz double, "
                 "qx double, qy double, qz double, qw double",
    "gt_poses": "frame_idx int, base_tx double, base_ty double, base_tz double, base_qx double, base_qy double, "
                "base_qz double, base_qw double, cam_tx double, cam_ty double, cam_tz double, cam_qx double, "
                "cam_qy double, cam_qz double, cam_qw double",
    "segments": "frame_idx int, segment_id short, stamp_ns long, gt_object_id long, n_pixels long, "
                "n_points_strided long, mean_depth_m double, is_dynamic boolean, is_far boolean",
    "gt_objects": "gt_object_id long, color_hex string, instance_idx int, r int, g int, b int, first_frame int, "
                  "last_frame int, n_frames_seen long, n_frames_promoting long, max_px long, total_px long, "
                  "n_voxels long, cx double, cy double, cz double, min_x double, min_y double, min_z double, "
                  "max_x double, max_y double, max_z double",
    "clouds": "frame int, segment_id int, gt_object_id long, x float, y float, z float",
    "arrivals": "topic string, stamp_ns long, recv_mono_ns long, recv_wall_ns long, seq int",
    "tracklets": "tracklet_id long, gt_object_id long, first_frame int, last_frame int, emit_frame int, "
                 "flushed_at_end boolean, n_frames_observed long, n_points_raw long, n_points long, n_far long, "
                 "dist_min_m double, dist_mean_m double, n_embedded long, color_hex string, centroid array<double>, "
                 "extent_m double",
    "keyframes": "kf long, seq long, frame_idx long, stamp_ns long, n_obs long, n_enc long, obs_start long",
    "observations": "obs long, kf_index long, tracklet_id long, points_num long, points_start long, "
                    "depth_valid_ratio float, seg_conf float, id_emb array<float>, query_emb array<float>, "
                    "mask_bits binary",
    "gt_vis": "ep_index int, frame int, px_full int, px_crop int",
    "gt_labels": "frame int, v int, u int, value int",
    "difficulty": "frame int, ep_index int, trunc float, occ float, min_dim int, sil_px long, vis_px long, "
                  "level byte, at_border boolean, sil_total_px long",
    "tracklet_set": "stamp_ns long, frame_id string, tracklet_ids array<long>, points_num array<long>, "
                    "points array<float>, depth_valid_ratio array<float>, seg_conf array<float>, "
                    "id_emb array<float>, query_emb array<float>",
}
