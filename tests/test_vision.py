import colorsys

import numpy as np

from kinelake.operators import vision

R = np.random.RandomState(4)
PICTURE = R.randint(0, 256, (36, 64, 3)).astype(np.uint8)


def test_hsv_equals_the_library():
    for p, q in zip(PICTURE[0], vision.hsv(PICTURE)[0]):
        h, s, v = colorsys.rgb_to_hsv(*(p / 255.0))
        assert abs(q[0] - h) < 1e-9 and abs(q[1] / 255 - s) < 1e-9 and abs(q[2] / 255 - v) < 1e-9
    assert vision.hsv_distance(PICTURE, PICTURE) == 0


def test_descriptors():
    smooth = np.kron(PICTURE[:9, :16], np.ones((8, 8, 1))).astype(np.uint8)
    d = vision.view_descriptor(smooth)
    assert d.shape == (432,) and np.allclose(d.reshape(9, 16, 3), smooth[::8, ::8] / 255)
    assert vision.view_descriptor(np.zeros((36, 64, 3), np.uint8)).size == 0 and vision.view_descriptor(np.full((36, 64, 3), 99, np.uint8)).size == 0
    assert abs(vision.colour_histogram(PICTURE).sum() - 1) < 1e-9
    barred = np.concatenate([np.zeros((4, 64, 3), np.uint8), PICTURE, np.zeros((4, 64, 3), np.uint8)])
    assert np.array_equal(vision.without_bars(barred), PICTURE) and np.array_equal(vision.without_bars(PICTURE), PICTURE)
    assert vision.grid(PICTURE, 9, 16).shape == (9, 16, 3)


def test_cameras_and_copies():
    d = R.rand(5, 432)
    wide = R.rand(9, 17, 3)
    assert vision.same_camera(wide[:, :16].ravel(), wide[:, 1:].ravel()) and not vision.same_camera(d[0], d[1]) and not vision.same_camera(np.zeros(0), np.zeros(0))
    assert vision.copied(d, d * 0.9 + 0.05) and vision.copied(d, d.reshape(5, 9, 16, 3)[:, :, ::-1].reshape(5, -1)) and not vision.copied(d, R.rand(5, 432)) and not vision.copied(d, d[[2, 1, 0, 4, 3]])


def test_detections(spark):
    box = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [30, 30, 5, 5.0]])
    assert vision.nms(box, np.array([0.5, 0.9, 0.3]), 0.5) == [1, 2]
    raw = np.zeros((3, 56))
    raw[:, :5] = [[50, 50, 20, 20, 0.9], [51, 50, 20, 20, 0.8], [10, 10, 5, 5, 0.1]]
    for r in (raw, raw.T):
        b, s, j = vision.decoded(r, 0.25, 2.0, 4.0, 0.0)
        assert np.allclose(b, [[18, 20, 10, 10]]) and list(s) == [0.9] and j.shape == (1, 17, 3)
    df = spark.createDataFrame([("a", 0.0, i, *map(float, r), s) for i, (r, s) in enumerate(zip(box, [0.5, 0.9, 0.3]))], "source string, t double, id long, x double, y double, w double, h double, score double")
    assert sorted(r.id for r in vision.suppressed_detections(df, 0.5).collect()) == [1, 2]


def test_rotation_excursion():
    turn = lambda a: np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    assert abs(vision.rotation_excursion(np.stack([turn(0), turn(0.3), turn(1.0)])) - np.degrees(1.0)) < 1e-9
