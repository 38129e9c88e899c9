"""pixloom: a Spark-native image augmentation and image analytics engine.

Images, masks, boxes, keypoints and clips are DataFrame rows.  Seeded random
pipelines are planned on the driver and run either as Catalyst expressions over
a pixel relation or as Arrow kernels over packed pixel buffers.
"""

__version__ = "0.1.0"
