"""Fixed values of the telemetry domain: channel catalogue, classes and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Topics and their numeric fields.
TOPIC_FIELDS: dict[str, list[str]] = {
    "actuator_controls_0": ["control[0]", "control[1]", "control[2]", "control[3]", "control[7]"],
    "actuator_outputs": [f"output[{i}]" for i in range(8)],
    "battery_status": ["voltage_v", "voltage_filtered_v", "current_a", "current_filtered_a", "discharged_mah", "remaining"],
    "cpuload": ["load", "ram_usage"],
    "distance_sensor": ["current_distance", "variance", "signal_quality"],
    "ekf2_innovations": [
        *[f"vel_pos_innov[{i}]" for i in range(6)], *[f"mag_innov[{i}]" for i in range(3)],
        "heading_innov", "hagl_innov", *[f"output_tracking_error[{i}]" for i in range(3)],
    ],
    "estimator_status": [
        "pos_test_ratio", "vel_test_ratio", "hgt_test_ratio", "mag_test_ratio", "hagl_test_ratio", "pos_horiz_accuracy",
        "pos_vert_accuracy", "filter_fault_flags", "innovation_check_flags", *[f"vibe[{i}]" for i in range(3)],
    ],
    "manual_control_setpoint": ["x", "y", "z", "r", "valid"],
    "rate_ctrl_status": ["rollspeed_integ", "pitchspeed_integ", "yawspeed_integ", "additional_integ1"],
    "sensor_combined": [
        *[f"gyro_rad[{i}]" for i in range(3)], *[f"accelerometer_m_s2[{i}]" for i in range(3)],
        *[f"magnetometer_ga[{i}]" for i in range(3)], "baro_alt_meter",
    ],
    "sensor_preflight": ["accel_inconsistency_m_s_s", "gyro_inconsistency_rad_s", "mag_inconsistency_angle"],
    "system_power": ["voltage5v_v", "voltage3v3_v", "brick_valid", "usb_valid", "servo_valid"],
    "vehicle_air_data": ["baro_alt_meter", "baro_temp_celcius", "baro_pressure_pa", "rho"],
    "vehicle_angular_velocity": ["xyz[0]", "xyz[1]", "xyz[2]"],
    "vehicle_attitude": ["q[0]", "q[1]", "q[2]", "q[3]", "rollspeed", "pitchspeed", "yawspeed"],
    "vehicle_attitude_setpoint": ["roll_body", "pitch_body", "yaw_body", "thrust_body[2]"],
    "vehicle_land_detected": ["alt_max", "freefall", "ground_contact", "maybe_landed", "landed", "in_ground_effect"],
    "vehicle_local_position": [
        "x", "y", "z", "vx", "vy", "vz", "ax", "ay", "az", "dist_bottom", "dist_bottom_rate", "eph", "epv", "heading",
        "xy_valid", "z_valid", "v_xy_valid", "v_z_valid",
    ],
    "vehicle_magnetometer": [f"magnetometer_ga[{i}]" for i in range(3)],
    "vehicle_rates_setpoint": ["roll", "pitch", "yaw", "thrust_body[2]"],
    "vehicle_status": ["nav_state", "arming_state", "failsafe", "pre_flight_checks_pass", "rc_signal_lost"],
    "vehicle_status_flags": [
        "condition_global_position_valid", "condition_local_position_valid", "condition_local_velocity_valid",
        "condition_local_altitude_valid", "condition_battery_healthy",
    ],
    "vehicle_vision_position": ["x", "y", "z", "xy_valid", "z_valid", "v_xy_valid", "v_z_valid"],
    "vehicle_visual_odometry": ["x", "y", "z", "q[0]", "q[1]", "q[2]", "q[3]"],
}
CHANNELS = [f"{topic}.{field}" for topic, fields in TOPIC_FIELDS.items() for field in fields]

# Subsystem classes.
CLASS_IDS = {"Mechanical/Electrical": 1, "External Position": 2, "Global Position": 3, "Altitude": 4, "Uncategorized": 5}

# Ordered substring rules, channel name -> subsystem.
TOKEN_RULES = (
    ("External Position", ("vehicle_vision_position",)),
    ("Altitude", ("distance_sensor", "hagl", "hgt", "pos_vert_accuracy", ".z", ".vz", ".az", "dist_bottom", "land_detected")),
    ("Global Position", ("pos_test_ratio", "pos_horiz_accuracy", "heading_innov", "vel_pos_innov[3]", "vel_pos_innov[4]", ".x", ".y", ".vx", ".vy", ".eph", ".epv")),
    ("Mechanical/Electrical", ("actuator", "battery", "system_power", "cpuload", "vibe", "gyro", "accelerometer", "rate_ctrl", "attitude", "rates_setpoint", "sensor_preflight")),
)

# Exact rules, first by topic, then by (topic, field), then by topic.
PAIR_RULES = {
    "first_topics": {"vehicle_vision_position": "External Position"},
    "pairs": {
        "Altitude": (
            "distance_sensor.current_distance", "ekf2_innovations.hagl_innov", "ekf2_innovations.vel_pos_innov[5]",
            "estimator_status.hagl_test_ratio", "estimator_status.hgt_test_ratio", "estimator_status.pos_vert_accuracy",
            "vehicle_local_position.z", "vehicle_local_position.vz", "vehicle_local_position.az", "vehicle_local_position.epv",
            "vehicle_local_position.dist_bottom", "vehicle_local_position.dist_bottom_rate",
        ),
        "Global Position": (
            "ekf2_innovations.heading_innov", "ekf2_innovations.vel_pos_innov[3]", "ekf2_innovations.vel_pos_innov[4]",
            "estimator_status.pos_horiz_accuracy", "estimator_status.pos_test_ratio", "vehicle_local_position.x",
            "vehicle_local_position.y", "vehicle_local_position.vx", "vehicle_local_position.vy", "vehicle_local_position.ax",
            "vehicle_local_position.ay", "vehicle_local_position.eph",
        ),
    },
    "topics": {
        "vehicle_land_detected": "Altitude",
        **{
            t: "Mechanical/Electrical"
            for t in (
                "actuator_controls_0", "actuator_outputs", "battery_status", "cpuload", "rate_ctrl_status", "sensor_combined",
                "sensor_preflight", "vehicle_attitude", "vehicle_attitude_setpoint", "vehicle_rates_setpoint",
            )
        },
    },
}

# Ordered path exclusion rules.
EXCLUSION_RULES = (
    ("examples", ("/examples/",)),
    ("templates", ("/templates/",)),
    ("tests", ("/tests/",)),
    ("tests", ("/test/",)),
    ("posix_platform", ("/platforms/posix/",)),
    ("qurt_platform", ("/platforms/qurt/",)),
    ("bebop_specific", ("bebop",)),
    ("linux_specific", ("linux",)),
    ("snapdragon_specific", ("snapdragon",)),
    ("simulation_or_replay", ("/simulator/",)),
    ("simulation_or_replay", ("/replay/",)),
    ("simulation_or_replay", ("_sim",)),
    ("hardware_test", ("hwtest",)),
)

# Publication and subscription hints and the topic token of source texts.
TOPIC_TOKEN = r"ORB_ID\s*\(\s*([A-Za-z0-9_]+)\s*\)"
PUBLISH_HINTS = ("uORB::Publication", "uORB::PublicationMulti", "uORB::PublicationQueued", "orb_advertise", "orb_publish")
SUBSCRIBE_HINTS = (
    "uORB::Subscription", "uORB::SubscriptionData", "uORB::SubscriptionInterval", "uORB::SubscriptionCallback", "orb_subscribe",
)


def channel_catalogue(spark: SparkSession, topics: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(t, f, f"{t}.{f}") for t, fields in (topics or TOPIC_FIELDS).items() for f in fields]
    return spark.createDataFrame(rows, "topic STRING, field STRING, channel STRING")
